"""Streams of cells: record windows with late data, as an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str = "ts", keys: list[str] | None = None, value: str = "value", size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, sum and largest value by window and keys; works alike on streams and on tables.

    On a stream, a window is given out once it lies ``late`` behind the newest event, and later events are dropped.
    """
    source = events
    if events.isStreaming:  # watermarks want a time with a zone
        source = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = source.groupBy(window.alias("w"), *(keys or [])).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), "n", "total", "most")
