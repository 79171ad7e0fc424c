"""Column builders and the few Python functions that Spark lacks."""
