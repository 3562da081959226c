"""Reads, writes and model bundle persistence."""
from .tables import read_table

__all__ = ["read_table"]
