"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, scalar


def _least(edges: DataFrame) -> DataFrame:
    """Each u of (u, v) with the least of itself and its v: partial minima first, so that hubs stay cheap."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least(both), "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``u`` and ``v``, the least node of u's component, for every u that isn't the least.

    ``edges``: u, v (longs). Repeats and loops do no harm; without edges the result is empty. Each round is written to the shared
    folder; the rounds grow as the logarithm of the longest path. Stars are the fixed points.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        after = materialize(_small_star(_large_star(now)).where("u <> v").distinct())
        row = scalar(after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        discard(now)
        now = after
        if (row.n, row["sum"]) == mark or not row.n:
            return now
        mark = (row.n, row["sum"])
