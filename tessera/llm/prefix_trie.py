"""A trie of conversations by their first turns: how many share each prefix, and what sharing saves.

A node is a sequence of first turns, keyed by a digest that is carried along each conversation, row by row; its parent is the digest one
turn shorter. Conversations of equal prefixes meet by key, pre-aggregated. What a node's subtree holds comes from pointer jumping: in each
round a node adds the sums that point to it, and its pointer jumps to where its pointer points, so that the rounds are the logarithm of
the depth. Each round is a written table: lost executors cost their tasks only.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, scalar

#: Bytes of a node's key.
KEY = 16
ROOT = hashlib.sha256().digest()[:KEY]
EMPTY = hashlib.sha256().hexdigest()


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, n (from 1), role, text of ``rows`` (conv_id, turn, role, text): by turn, null first, then by role and text.

    Null roles and texts are empty; rows of no conversation are left out, repeated rows are turns like others, other columns go.
    """
    named = rows.where("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return named.select("conv_id", n.cast("long").alias("n"), "role", "text")


def rebuilt(rows: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``numbered`` rows with shared beginnings: conversation c takes the first h turns of c - c % ``every``, h being CRC-32 of c modulo ``most``,
    and then its own after its first h. A row with n 0 and no role stands for each conversation, as one may have no turn left.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    convs = rows.select("conv_id").distinct()
    lent = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("lender"), h.alias("h"))
    shared = rows.where(F.col("n") < most).select(F.col("conv_id").alias("lender"), "n", "role", "text")
    front = lent.join(shared, "lender").where("n <= h").select("conv_id", F.lit(1).alias("part"), "n", "role", "text")
    own = rows.where(F.col("n") > h).select("conv_id", F.lit(2).alias("part"), "n", "role", "text")
    none = F.lit(None).cast("string")
    marks = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), none.alias("role"), none.alias("text"))
    return marks.unionByName(front).unionByName(own)


_STEP = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of each conversation; the last one is known when the next conversation begins."""
    held: list | None = None
    running = hashlib.sha256()
    out: list[list] = []

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _STEP, strict=True)], schema=_STEP)

    for batch in batches:
        for conv_id, part, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "part", "role", "text")), strict=True):
            if held:
                held[-1] = part == 0
                out.append(held)
            if part == 0:
                running = hashlib.sha256()
                held = [conv_id, 0, ROOT, None, 0, False]
            else:
                said, words = role.encode(), text.encode()
                running.update(struct.pack("<qq", len(said), len(words)) + said + words)
                held = [conv_id, held[1] + 1, running.digest()[:KEY], held[2], len(words), False]
            if len(out) >= 4000:
                yield flushed()
                out.clear()
    if held:
        held[-1] = True
        out.append(held)
        yield flushed()


_ENDS = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the ids that end at each key; rows are sorted by key and id."""
    key, digest, out = None, hashlib.sha256(), []
    for batch in batches:
        for k, conv_id in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
        if len(out) >= 4000:
            yield pa.RecordBatch.from_pylist([dict(zip(_ENDS.names, x, strict=True)) for x in out], _ENDS)
            out = []
    if key is not None:
        out.append((key, digest.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(_ENDS.names, x, strict=True)) for x in out], _ENDS)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, bytes (of the last turn's text), last (the whole conversation) of each prefix of ``rebuilt`` rows."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "n")
    return ordered.mapInArrow(_digests, "conv_id long, depth long, key binary, parent binary, bytes long, last boolean")


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """key and the sums of ``sums`` over each node's subtree, itself included, of ``nodes`` (key, parent, depth, ...), by pointer jumping.

    After k rounds a node has what is less than 2^k below it, and points 2^k up. Sums that point to one node are pre-aggregated; many
    pointers to one node are a skewed join, which adaptive execution splits.
    """
    deepest = scalar(nodes.agg(F.max("depth").alias("d")))["d"] or 0
    now = materialize(nodes.select("key", F.col("parent").alias("up"), *sums))
    for _ in range(int(deepest).bit_length()):
        below = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(*(F.sum(c).alias(f"_{c}") for c in sums))
        above = now.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("_up"))
        more = now.join(below, "key", "left").join(above, "up", "left")
        then = materialize(more.select("key", F.col("_up").alias("up"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums)))
        discard(now)
        now = then
    return now.drop("up")


def trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node, from ``rebuilt`` rows.

    A node's conv_id is its smallest member's. No conversation, no root.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = materialize(prefixes(turns))
    each = steps.groupBy("key").agg(*(F.min(c).alias(c) for c in ("conv_id", "depth", "parent", "bytes")), F.count(F.lit(1)).alias("n_convs"))
    children = each.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(
        each.join(children, "key", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    )
    ends = steps.where("last").select("key", "conv_id").repartition(n, "key").sortWithinPartitions("key", "conv_id").mapInArrow(_end_digests, "key binary, ends_sha256 string")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.drop("n_leaves", "saved_tokens").join(subtree_sums(nodes, ["n_leaves", "saved_tokens"]), "key").join(ends, "key", "left").join(parents, "parent", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )
