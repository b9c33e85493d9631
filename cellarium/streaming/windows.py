"""Event-time windows over a stream of events: an extension, as the analytics here are otherwise about tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Number and value of events by day and type. On a stream a day is closed when the watermark has passed it."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    groups = marked.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return groups.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", "value")


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)
