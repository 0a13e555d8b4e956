"""SimHash near-dedup by pigeonhole blocks.

A fingerprint's 64 bits are cut into six blocks. Two that differ in four bits or fewer share two blocks at least, so
the fifteen pairs of blocks are join keys of 20 to 22 bits. Fingerprints meet under their keys, Hamming distances are verified, and components follow.
Equal fingerprints are one node from the start. Keys shared by many fingerprints are dealt out in tiles, every pair of
tiles to a task of its own; a tile emits a spanning forest of its links and never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, placed, tidy
from .components import components

#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints of one key that a tile holds at most, on the average.
TILE = 256


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of the whole text's shingles as an unsigned number; without words 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, for case and white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), 42)
    n = len(words) - width + 1
    hashes = np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``docs`` with ``fp`` (the fingerprint's 64 bits as a signed long) in place of ``text``: of the whole text, 0 for null and for no words."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps)], names=[*kept, "fp"])

    schema = docs.select(*kept).schema.add("fp", "long")
    return docs.select(*kept, "text").mapInArrow(tidy(run), schema)


def _keys(fp: Column) -> Column:
    """For each pair of blocks the number of the pair above the blocks' bits."""

    def bits(at: int, n: int) -> Column:
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))

    return F.array(
        *(
            F.lit(k << 22).cast("long").bitwiseOR(F.shiftleft(bits(*a), 11)).bitwiseOR(bits(*b))
            for k, (a, b) in enumerate(combinations(BLOCKS, 2))
        )
    )


def forest(fps: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what pairs of the same run within ``radius`` connect; each run has a tree a component at most."""
    n = len(fps)
    left, right = [], []
    alive = np.arange(n)
    d = 0
    while True:
        d += 1
        alive = alive[alive + d < n]
        alive = alive[runs[alive] == runs[alive + d]]
        if not len(alive):
            break
        near = alive[np.bitwise_count((fps[alive] ^ fps[alive + d]).view(np.uint64)) <= radius]
        left.append(near)
        right.append(near + d)
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    moved = np.nonzero(label != np.arange(n))[0]
    return fps[moved], fps[label[moved]]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of ``fp`` within ``radius`` bits; ``distinct`` has each fp once."""
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = (
        keyed.join(full, "key")
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("fp", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    )
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def emit(fps, key, a, b):
            new = np.ones(len(fps), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            u, v = forest(fps, np.cumsum(new), radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            fps, key, a, b = columns
            if not len(fps):
                continue
            whole = (key != key[-1]) | (a != a[-1]) | (b != b[-1])
            cut = int(whole.sum())  # rows are sorted: the last run may go on in the next batch
            if cut:
                yield emit(*(c[:cut] for c in columns))
            rest = [c[cut:] for c in columns]
        if rest:
            yield emit(*rest)

    return (
        met.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(tidy(run), "u long, v long")
    )


def classes(printed: DataFrame, radius: int = 4) -> DataFrame:
    """A row for each ``fp`` of ``printed`` (doc_id, fp): ``fp`` and ``root``, the fingerprint that names its component."""
    distinct = materialize(printed.select("fp").distinct())
    roots = components(links(distinct, radius))
    return distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", F.coalesce("v", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable) for every row of ``docs``.

    ``docs``: doc_id, text. A null or empty text has fingerprint zero and is linked like any other; a component whose ids are
    all null has a null id; repeated rows each have a row; an empty table gives an empty one. A fingerprint shared by
    many rows is one node; ids are reduced by partial minima.
    """
    printed = materialize(fingerprints(docs.select("doc_id", "text"), width))
    by_fp = printed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = by_fp.join(classes(printed, radius), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return printed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest doc_id, then the first as read.

    ``docs``: doc_id, text and any others, of any names. Null and empty texts are alike, a null doc_id comes after all others; an
    empty table stays empty.
    """
    whole = placed(docs)
    printed = materialize(fingerprints(whole.select("_row.doc_id", "_row.text", F.col("_place").alias("place")), width))
    by_fp = printed.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("first"))
    best = by_fp.join(classes(printed, radius), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return whole.join(best.select(F.col("first.place").alias("_place")), "_place", "left_semi").select("_row.*")
