"""Windows over event time, for batch frames and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates by window and keys; late: how late rows may come, for a stream."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sliding(events: DataFrame, time: str, width: str, step: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    out = rows.groupBy(F.window(time, width, step).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    """Sessions of each key that end after a gap without events."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    out = rows.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(*aggregates)
    return out.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *[c for c in out.columns if c != "_w"])
