"""cadastra: a PySpark-native analytics engine for versioned media catalogues."""

__version__ = "0.1.0"
