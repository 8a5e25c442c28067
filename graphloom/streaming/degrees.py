"""Degrees of a growing edge stream, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_degrees(edges: DataFrame, watermark: str = "10 minutes", window: str | None = None) -> DataFrame:
    """(id, degree), or per event-time window, from a stream of (ts, src, dst); repeated edges count once per window.

    Without a window the result is the running degree (complete or update mode); with one, late rows beyond the
    watermark are dropped by Spark and windows can be appended.
    """
    ends = F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")
    if window is None:
        return edges.select(ends).groupBy("id").agg(F.count("*").alias("degree"))
    rows = edges.withWatermark("ts", watermark).select(F.window("ts", window).alias("w"), ends, F.struct("src", "dst").alias("e"))
    grouped = rows.groupBy("w", "id").agg(F.size(F.collect_set("e")).alias("degree"))
    return grouped.select(F.col("w.start").alias("start"), "id", "degree")
