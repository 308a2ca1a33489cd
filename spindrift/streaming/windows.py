"""Event-time windows that run alike over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events with ts as a timestamp, and a watermark if they stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay) if events.isStreaming else rows


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """user_id, start, events of each session."""
    out = timed(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), "events")


def tumbling_counts(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """kind, start, events, total of each window."""
    out = timed(events, delay).groupBy(F.col("event_type").alias("kind"), F.window("ts", size).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select("kind", F.col("w.start").alias("start"), "events", "total")


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first event of each id; a stream remembers ids as long as the watermark allows."""
    rows = timed(events, delay)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])


def enriched(events: DataFrame, people: DataFrame, key: str = "user_id") -> DataFrame:
    """A stream joined with a table."""
    return events.join(people, key, "left")
