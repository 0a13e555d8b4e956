"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, served again from its start when it is through. A
document's virtual finish time is the source's cumulative tokens up to its end, divided by the source's target. The
queues are served together until the total budget is spent, at virtual time 1; documents being served at that
moment are cut there. The copies are sorted by virtual finish time over ranges, and prefix sums over the ranges truncate the mix
at the total budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, piece_of, scalar

#: Rows of one source that a task accumulates at once.
ROWS_PER_BUCKET = 65_536
#: Virtual time at which the budget is spent: the targets sum to the budget, and each queue gets its target per unit.
BUDGET_TIME = 1.0


def ranked(sources: DataFrame) -> DataFrame:
    """``place``: each source's place from 0 by code point, null last, without one task holding all sources."""
    n = sources.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = materialize(
        sources.repartitionByRange(int(n), F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    )
    sums = ranged.groupBy("_part").count()  # a row for each partition
    before = sums.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    local = W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return (
        ranged.withColumn("_local", F.row_number().over(local))
        .join(F.broadcast(before), "_part")
        .withColumn("place", (F.col("_local") - 1 + F.col("_before")).cast("long"))
        .drop("_part", "_local", "_before")
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """``source``, ``total``, ``target`` from rows of ``source`` and ``size``.

    The budget, ``share`` of all sizes, is dealt by weight; a target stops at ``repeats`` times its source's size and
    the excess is dealt again, until none is above: the level rises until a round adds no source to those that stop.
    """
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"))
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    sources = materialize(
        ranked(totals).withColumn("weight", F.get(pattern, (F.col("place") % len(weights)).cast("int")))
    )
    stop = F.lit(float(repeats)) * F.col("total")
    budget = share * (scalar(sources.agg(F.sum("total")))[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = stop <= F.lit(level) * F.col("weight")
        row = scalar(
            sources.agg(
                F.sum(F.when(full, 1).otherwise(0)).alias("n"),
                F.sum(F.when(full, stop).otherwise(0.0)).alias("held"),
                F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            )
        )
        if row.n == stopped or not row.open:
            break
        level, stopped = (budget - row.held) / row.open, row.n
    return sources.select("source", "total", F.least(stop, F.lit(level) * F.col("weight")).alias("target"))


def schedule(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 1
) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to every row.

    ``docs``: ``source``, ``size`` (long) and ``shuffle_key`` (64-bit hash of the row), as a table that can be read
    again. ``copies``: for each pass over the source a struct of ``pass``, ``start`` and ``finish`` (virtual times) and
    ``taken``, the words of that copy served by ``BUDGET_TIME``. A null source is a source like any other; rows of size
    0 take nothing; rows with equal keys may change places; an empty table stays empty. A source of any size is
    accumulated in hash buckets of its rows, each by one task.
    """
    kept = docs.columns
    goals = targets(docs.select("source", "size"), weights, share, repeats)
    buckets = max(1, docs.count() // ROWS_PER_BUCKET)
    dealt = docs.withColumn("_key", F.xxhash64("shuffle_key", F.lit(seed))).withColumn("_bucket", piece_of(F.col("_key"), buckets))
    sums = dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = sums.select(
        F.col("source").alias("_source"),
        F.col("_bucket").alias("_at"),
        (F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket")) - F.col("_sum")).alias("_before"),
    )
    before = before.join(goals, F.col("_source").eqNullSafe(goals["source"])).drop("source")
    inside = W.partitionBy("source", "_bucket").orderBy("_key", "shuffle_key").rowsBetween(W.unboundedPreceding, 0)
    queued = (
        dealt.withColumn("_end", F.sum("size").over(inside))
        .join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_at")))
        .withColumn("_end", F.col("_end") + F.col("_before"))
    )
    target = F.when(F.col("target") > 0, F.col("target")).otherwise(F.lit(1.0))

    def copy(k: int):
        end = F.col("_end") + F.lit(k) * F.col("total")
        start = end - F.col("size")
        served = F.floor(F.lit(BUDGET_TIME) * F.col("target") - start + F.lit(1e-6))
        return F.struct(
            F.lit(k).alias("pass"),
            (start / target).alias("start"),
            (end / target).alias("finish"),
            F.least(F.greatest(served, F.lit(0)), F.col("size")).cast("long").alias("taken"),
        )

    return queued.select(
        *kept, F.col("total").alias("source_size"), "target", F.array(*(copy(k) for k in range(repeats))).alias("copies")
    )


def running(copies: DataFrame, amount: str) -> DataFrame:
    """``copies`` sorted by virtual finish time over all of them, with ``upto``: the sum of ``amount`` up to and with each.

    Ranges of the order are as many as shuffle partitions; their sums, a row for each, give what lies before a range.
    """
    n = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["virtual_finish", "shuffle_key", "pass"]
    ranged = materialize(copies.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return ranged.withColumn("_in", F.sum(amount).over(inside)).join(F.broadcast(before), "_part").withColumn("upto", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def mixture(scheduled: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each copy, in the order of virtual finish times: pass, virtual_finish, ``taken`` and ``upto``, in place of ``copies``.

    ``taken`` is what the copy got by virtual time 1, cut where the sum over the order passes the total budget; ``upto`` is that sum.
    With ``whole`` a copy is taken whole or not at all: the order's first ones whose sizes sum up to the budget at most; rows of
    size 0 come once, in their place. Rows of a table that ``schedule`` made from a written one.
    """
    c = F.col("copy")
    budget = F.lit(float(scalar(scheduled.groupBy("source").agg(F.max("target").alias("target")).agg(F.sum("target")))[0] or 0.0))
    copies = scheduled.withColumn("copy", F.explode("copies")).withColumns({"pass": c["pass"], "virtual_finish": c["finish"], "taken": c["taken"]}).drop("copies", "copy")
    if whole:
        sorted_ = running(copies.where((F.col("size") > 0) | (F.col("pass") == 0)).drop("taken"), "size")
        return sorted_.where(F.col("upto") <= budget).withColumn("taken", F.col("size"))
    sorted_ = running(copies, "taken")
    room = F.ceil(budget) - (F.col("upto") - F.col("taken"))
    return sorted_.withColumn("taken", F.greatest(F.least(F.col("taken"), room), F.lit(0)).cast("long"))
