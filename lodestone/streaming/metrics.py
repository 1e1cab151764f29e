"""Event-time metrics, the same plan for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Start of the window, event type, count and sum of value; with a watermark if late is given."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now, into a memory table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end and count of sessions parted by gaps."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
