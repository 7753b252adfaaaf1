"""Structured Streaming over event tables: windows, sessions, deduplication.

An extension: the language itself has no stream operators beyond
``time::bucket``.  All functions take and give streaming or batch DataFrames.
"""

from tessera.streaming.events import deduplicated, session_counts, window_counts

__all__ = ["deduplicated", "session_counts", "window_counts"]
