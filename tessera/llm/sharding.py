"""Sharding by sampled splitters.

Records are ordered by a hash of their text, so that equal texts are neighbours. A size-weighted
sample of keys gives the quantile boundaries of some hundreds of ranges; each record finds its range by
a binary search in that literal array. Ranges that turn out overfull (a group of copies can hold a third
of all rows) are subdivided by a hash of the row. Prefix sums over the ranges, whose number is a
parameter, and over the records of each range give every record its place in the whole, and places give shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, piece_of, scalar, unit_interval

#: Rows of a range that one task sorts; bounds on the number of ranges; sampled keys for each range.
ROWS_PER_RANGE, MIN_RANGES, MAX_RANGES, KEYS_PER_RANGE = 100_000, 256, 16_384, 16


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries from a size-weighted sample of about ``ranges * KEYS_PER_RANGE`` keys.

    A key that fills more than one quantile gets a range of its own.
    """
    share = F.col("size") / F.lit(float(max(total, 1))) * F.lit(float(ranges * KEYS_PER_RANGE))
    keys = sorted(
        r.text_key for r in rows.where(unit_interval(F.xxhash64("row_key", F.lit(7))) < share).select("text_key").collect()
    )
    picked = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    own = {a for a, b in zip(picked, picked[1:], strict=False) if a == b}
    return sorted({*picked, *(k + 1 for k in own if k < 2**63 - 1)})


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``: a binary search by a fold over powers of two."""
    if not bounds:
        return F.lit(0)
    n, steps = len(bounds), [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.array(*map(F.lit, bounds))

    def step(found, power):
        return F.when(
            (found + power <= n) & (F.get(table, F.least(found + power, F.lit(n)) - 1) <= key), found + power
        ).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def shard(rows: DataFrame, shards: int = 8, tolerance: float = 0.005) -> DataFrame:
    """Adds ``shard`` (from 0, sizes near equal) and ``slot`` (gapless from 0 in the shard) to ``rows``.

    ``rows``: ``size`` (long, above 0), ``text_key`` and ``row_key`` (64-bit hashes of the text and of the row) and any
    other columns, as a table that can be read again. Equal text keys stay in one shard where that moves a shard's edge
    by at most ``tolerance`` of a shard; larger groups are cut at the edge. An empty table gives an empty table; nulls
    in other columns pass through; repeated rows each get a slot of their own.
    """
    kept = rows.columns
    whole = scalar(rows.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    total, n = whole["size"] or 0, whole["n"]
    ranges = min(max(n // ROWS_PER_RANGE, MIN_RANGES), MAX_RANGES)
    bounds = splitters(rows, total, ranges)
    fair = max(total / ranges, 1.0)

    ranged = rows.withColumn("_range", range_of(F.col("text_key"), bounds))
    measured = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    # At most ``ranges`` pieces more than ranges: each piece of an overfull range holds a fair share.
    cut = {
        r["_range"]: int(r["_bytes"] // fair) + 1
        for r in measured.where(F.col("_bytes") > 2 * fair).collect()
    }
    pieces = F.coalesce(F.get(F.map_values(m := _literal_map(cut)), F.array_position(F.map_keys(m), F.col("_range")).cast("int") - 1), F.lit(1)) if cut else F.lit(1)
    cut_up = materialize(ranged.withColumn("_piece", piece_of(F.col("row_key"), pieces)))

    order = W.orderBy("_range", "_piece")  # over the bounded number of pieces
    offsets = (
        cut_up.groupBy("_range", "_piece")
        .agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_range",
            "_piece",
            (F.sum("_bytes").over(order) - F.col("_bytes")).alias("_bytes_before"),
            (F.sum("_rows").over(order) - F.col("_rows")).alias("_rows_before"),
        )
    )
    inside = W.partitionBy("_range", "_piece").orderBy("text_key", "row_key")
    group = W.partitionBy("_range", "_piece", "text_key")
    share = float(max(total, 1)) / shards

    def at(place: Column) -> Column:
        return F.least(F.greatest(F.floor(place / F.lit(share)), F.lit(0)), F.lit(shards - 1)).cast("int")

    placed = (
        cut_up.withColumns(
            {
                "_end": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)),
                "_row": F.row_number().over(inside),
            }
        )
        .join(F.broadcast(offsets), ["_range", "_piece"])
        .withColumns({"_end": F.col("_end") + F.col("_bytes_before"), "_row": F.col("_row") - 1 + F.col("_rows_before")})
        .withColumns({"_from": F.min(F.col("_end") - F.col("size")).over(group), "_to": F.max("_end").over(group)})
        .withColumn(
            "shard",
            F.when(F.col("_to") - F.col("_from") <= 2 * tolerance * share, at((F.col("_from") + F.col("_to")) / 2)).otherwise(
                at(F.col("_end") - F.col("size") / 2)
            ),
        )
        .select(*kept, "shard", "_row")
    )
    placed = materialize(placed)
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_row") - F.col("_first")).cast("long")).drop("_row", "_first")


def _literal_map(values: dict[int, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))


def sized(docs: DataFrame) -> DataFrame:
    """The narrow rows that ``shard`` deals out: doc_id, size (UTF-8 bytes plus 1), text_crc32 (null text: null) and the keys."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64("text").alias("text_key"),
        F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("row_key"),
    )
