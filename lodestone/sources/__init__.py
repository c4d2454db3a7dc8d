"""Readers and writers."""

from lodestone.sources.tables import TABLES, load

__all__ = ["TABLES", "load"]
