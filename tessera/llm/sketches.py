"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and the ``LEAST`` smallest hashes in any case,
so that texts of a few words have one too. Its own threshold follows from what it holds: the fixed one, or its largest hash where
that lies above. Two sketches are compared below the smaller of their thresholds, so that containment can be estimated between a
sentence and a book; merging is the union, cut to the same rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import piece_of, tidy
from .sharding import range_of

WIDTH, FRACTION, LEAST = 5, 4, 8
#: Hashes below this are kept: one in ``FRACTION``.
THRESHOLD = 2**64 // FRACTION
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.zeros(0, dtype=np.uint64)


class WordHashes(dict):
    """Hashes of words, at most ``most`` of them kept."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def sketch(text: str, cache: WordHashes) -> np.ndarray:
    """The kept hashes of the whole text's shingles, ascending; fewer words than a shingle has are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return _EMPTY
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        x = h[:n].copy()
        for k in range(1, width):
            x = (x ^ (x >> np.uint64(29))) * _ODD + h[k : n + k]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return trimmed(x)


def trimmed(hashes: np.ndarray) -> np.ndarray:
    hashes = np.unique(hashes)
    return hashes[: max(int(np.searchsorted(hashes, np.uint64(THRESHOLD))), min(LEAST, len(hashes)))]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets of shingles."""
    return trimmed(np.concatenate([a, b]))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of the smaller set that is in the other: 1 for two empty sets, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # Fewer than LEAST hashes are all there are; else a sketch is complete below the fixed threshold or its largest hash.
    top = np.uint64(min(max(THRESHOLD - 1, int(x[-1])) if len(x) >= LEAST else 2**64 - 1 for x in (a, b)))
    a, b = (x[: int(np.searchsorted(x, top, side="right"))] for x in (a, b))
    if not len(a) or not len(b):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def written(hashes: np.ndarray) -> str:
    """The upper halves of the hashes, eight hex digits each, ascending."""
    return (hashes >> np.uint64(32)).astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much from the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_and_compare(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``.

    ``docs``: doc_id (a number), text. The next document is that of the next smaller doc_id, nulls last; rows of equal doc_id
    follow by their texts' hashes; after the last comes the first, and a lone document follows itself. Null texts are empty.

    The texts move once, into ranges of doc_id by quantiles; a range of one id alone (or of nulls) that holds more than twice its share is
    cut further by the order of the hashes. The first row of each range goes to the range before it too, as what follows its last.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * tasks
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), 20 * ranges)).first()[0] if ranges > 1 else []
    bounds = sorted(set(cuts or []))
    bounds = sorted({*bounds, *(b + 1 for b in bounds)}) if bounds and isinstance(bounds[0], int) else bounds  # an id in many rows is alone
    r = F.when(F.col("doc_id").isNull(), -1).otherwise(range_of(F.col("doc_id"), bounds))
    found = docs.groupBy(r.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one")).collect()  # a row for each range
    fair = max(1, sum(x["n"] for x in found) // ranges)
    pieces = {x["r"]: -(-x["n"] // fair) for x in found if x["one"] and x["n"] > 2 * fair}
    cut = F.lit(1)
    for k, n in pieces.items():
        cut = F.when(F.col("r") == k, n).otherwise(cut)
    ranged = docs.withColumn("r", r).withColumn("piece", piece_of(F.xxhash64("text"), cut) if pieces else F.lit(0))
    tops = ranged.groupBy("r", "piece").agg(F.max("doc_id").alias("top"))
    order = sorted(((x["r"], x["piece"]) for x in tops.select("r", "piece").collect()), key=lambda x: (-x[0], x[1]))
    before = spark.createDataFrame([(*x, *order[i - 1]) for i, x in enumerate(order)] or [(0, 0, 0, 0)], "_r int, _piece int, _to int, _at int")
    first = (
        ranged.join(F.broadcast(tops.withColumnsRenamed({"r": "_r", "piece": "_piece"})), (F.col("r") == F.col("_r")) & (F.col("piece") == F.col("_piece")) & F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("r", "piece")
        .agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first"))
        .join(F.broadcast(before), (F.col("r") == F.col("_r")) & (F.col("piece") == F.col("_piece")))
        .select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("first.text").alias("text"), F.col("_to").alias("r"), F.col("_at").alias("piece"), F.lit(True).alias("follows"))
    )
    schema = docs.select("doc_id").schema
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        held, rows = None, []

        def done(following: str, its: np.ndarray) -> None:
            doc_id, text, own = held
            new = edited(text, following)
            other = sketch(new, cache)
            rows.append((doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(other), containment(own, other), containment(own, its)))

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text, follows in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "follows")), strict=True):
                own = sketch(text, cache)
                if held:
                    done(text, own)
                held = None if follows else (doc_id, text, own)  # what follows is the last row of its range
            if rows:
                kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
                rows.clear()

    return (
        ranged.withColumn("follows", F.lit(False))
        .select("doc_id", "text", "r", "piece", "follows")
        .unionByName(first)
        .repartition(tasks, "r", "piece")
        .sortWithinPartitions(F.col("r").desc(), "piece", "follows", F.col("doc_id").desc(), F.xxhash64("text"))
        .select("doc_id", "text", "follows")
        .mapInArrow(tidy(run), schema)
    )
