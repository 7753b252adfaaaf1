"""Windowed and stateful operators over a stream of events with a time column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, time: str, width: str, keys: list[str], value: str | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count (and sum) for each window and key; state of closed windows is dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def session_counts(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events of each session: runs of a key's events less than ``gap`` apart."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark; batches are deduplicated whole."""
    marked = events.withWatermark(time, late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
