"""Progress of jobs from event rows, over tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far each kind of event brings a job.
STAGES = {"view": 1, "click": 2, "purchase": 3}


def states(events: DataFrame) -> DataFrame:
    """user_id, stage (the furthest so far), failed, n, kinds. On a stream ``kinds`` is a set's size, in update or complete mode."""
    stage = F.lit(0)
    for kind, k in STAGES.items():
        stage = F.when(F.col("event_type") == kind, k).otherwise(stage)
    kinds = F.size(F.collect_set("event_type")).cast("long")
    return events.groupBy("user_id").agg(
        F.max(stage).alias("stage"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.count(F.lit(1)).alias("n"), kinds.alias("kinds")
    )


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """window_start, event_type, n, total. With ``late`` on a stream, windows close so long after the latest event."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp_ntz" if not events.isStreaming else "timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each user and kind: repeats within the watermark are dropped."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return events.dropDuplicates(["user_id", "event_type"])


def last_entries(events: DataFrame, most: int = 200) -> DataFrame:
    """The most recent rows: a log of bounded length."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
