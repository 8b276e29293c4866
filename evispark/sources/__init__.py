"""Readers and writers."""

from evispark.sources.tables import load

__all__ = ["load"]
