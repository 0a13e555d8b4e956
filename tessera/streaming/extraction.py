"""Specification extraction as a stream of events: request, response, processed for each section, then complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import atomize


def events_of(lines: DataFrame) -> DataFrame:
    """file_id, section_id, event, specs (JSON) for each section of ``lines`` (file_id, section_id, line), and an end for each file."""
    made = atomize.atomize(lines).groupBy("file_id", "section_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("spec_text", "spec_id")))).alias("specs"))
    sections = lines.select("file_id", "section_id").distinct()
    each = sections.join(made, ["file_id", "section_id"], "left").withColumn("event", F.explode(F.array(*map(F.lit, ("request", "response", "processed")))))
    told = each.select("file_id", "section_id", "event", F.when(F.col("event") == "processed", F.coalesce("specs", F.lit("[]"))).alias("specs"))
    none = F.lit(None).cast("string")
    ends = lines.select("file_id").distinct().select("file_id", none.alias("section_id"), F.lit("complete").alias("event"), none.alias("specs"))
    return told.unionByName(ends)


def run(stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None):
    """Starts the query that writes the events of each micro-batch of lines as JSON lines under ``path``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        events = events_of(batch)
        (sink or (lambda df, i: df.write.mode("overwrite").json(f"{path}/batch={i}")))(events, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def section_progress(events: DataFrame) -> DataFrame:
    """file_id, section_id, state: requested, responded or completed, the furthest seen; repeats and late events change nothing."""
    rank = F.when(F.col("event") == "processed", 3).when(F.col("event") == "response", 2).when(F.col("event") == "request", 1).otherwise(0)
    names = F.array(*map(F.lit, ("none", "requested", "responded", "completed")))
    return events.where("section_id is not null").groupBy("file_id", "section_id").agg(F.get(names, F.max(rank)).alias("state"))
