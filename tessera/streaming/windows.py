"""Windows of event time that work on bounded and on streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, key: str, width: str, late: str = "1 hour") -> DataFrame:
    """Counts by key and window; on a stream, windows close when the watermark passes them."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("records"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "records")


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end when nothing comes for the gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select(key, "first_ts", "last_ts", "records")
