"""Streaming forms of the lifecycle rules (J9, J20), an extension: the evaluated system has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_events(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def activity(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events and their values by window and type; rows later than the watermark are dropped, and state is bounded."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))


def open_sessions(events: DataFrame, gap: str = "60 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a document without an event for ``gap``: what the stale sweep closes."""
    sessions = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"), F.max_by("event_type", "ts").alias("last_type"))
    return sessions.where("last_type <> 'purchase'")


def first_answers(events: DataFrame, key: str, lateness: str = "10 minutes") -> DataFrame:
    """The first answer of each key within the watermark; repeated and late ones are dropped."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])
