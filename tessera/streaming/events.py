"""Event-time windows over a stream, beyond the array operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts and sums of `value` in tumbling or sliding windows, with a watermark."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")
