"""Structured Streaming forms of operators."""

from evispark.streaming.counts import orphan_counts, orphan_keys

__all__ = ["orphan_counts", "orphan_keys"]
