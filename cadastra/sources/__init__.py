"""Readers of tables, provider payloads and media."""

from cadastra.sources.tables import table

__all__ = ["table"]
