"""Byte-level BPE encoding and decoding with higher-order functions.

A word's bytes, an array of pieces, are folded over its possible merges: each step joins the adjacent pieces whose union has
the lowest rank. Ranks are looked up in a literal: an array of small maps, most of them null, found by a hash of the pair. Decoding
concatenates the bytes of each id, in Arrow batches: as a higher-order function it took twice the CPU time of all the rest.

Distinct words are folded, not occurrences: the most frequent words of the corpus once each, a bounded number that goes to
the workers as a dictionary, and the other words once for each text that has them. No text is shuffled. A fold takes steps
in proportion to the square of a word's length, so words over ``FOLD_BYTES`` bytes are merged by a priority queue instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Mapped, give_back_driver, let, materialize, most_frequent, short_plans, slices, small_batches, tidy

#: Frequent words whose ids are broadcast, and the longest of them in bytes.
HEAD_WORDS, HEAD_BYTES = 1 << 19, 64
#: The longest word in bytes that is folded.
FOLD_BYTES = 256
#: Rows, and words in all, that are looked up at once.
SLICE, SLICE_WORDS = 2_000, 1 << 20
#: Places among which the ranks are dealt out, and what a pair's first piece counts there: a prime near 2^31 / 2^16.
BUCKETS, SPREAD = 1 << 17, 30_011
#: Seed of the hashes by which frequent words are found, that of Spark's own function.
SEED = 42
#: Stands for no rank.
NONE = 1 << 30
#: Ends a word's pieces when no merge is left: below all pieces.
DONE = "\x01"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two pieces whose merge makes ``token``: what merging its bytes by lower ranks alone leaves."""
    pieces, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(pieces) > 2:
        rank, at = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)))
        if rank >= top:
            raise ValueError(f"no merge of two pieces makes token {top}")
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return pieces[0], pieces[1]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length: the lowest rank first, the leftmost of equal ones, by a queue over a linked list."""
    n = len(word)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n

    def rank(i: int) -> int | None:
        j = after[i]
        return ranks.get(word[i : ends[j]]) if j < n else None

    queue = [(r, i, ends[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, end = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue  # one of the two was merged meanwhile
        alive[j], ends[i], after[i] = 0, end, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(queue, (r, k, ends[after[k]]))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


class Codec:
    """Columns that encode words and decode ids by ``ranks``.

    A piece is written as one character, ``FIRST`` code points above its rank, so that an array of pieces is a string,
    characters sort as ranks do, and the least character that adjacent pieces can become is the next merge.
    """

    FIRST = 256

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) + self.FIRST >= 0xD800:
            raise ValueError("more ranks than characters of the basic plane")
        #: For str.translate: characters that stand for bytes (as in Latin-1) to those that stand for pieces.
        self.bytes_to_pieces = {b: self.FIRST + ranks[bytes([b])] for b in range(256)}
        buckets: list[dict[str, str] | None] = [None] * BUCKETS
        for token, rank in ranks.items():
            if len(token) > 1:
                a, b = (self.FIRST + ranks[x] for x in merge_pair(token, ranks))
                at = (a * SPREAD + b) % BUCKETS
                buckets[at] = (buckets[at] or {}) | {chr(a) + chr(b): chr(self.FIRST + rank)}
        self._table = json.dumps(buckets, separators=(",", ":"), ensure_ascii=False)
        self.ranks = ranks

    def table(self) -> Column:
        """The map of pairs to what they become, as a constant that the optimizer folds into a literal."""
        return F.from_json(F.lit(self._table), "array<map<string,string>>")

    def fold(self, table: Column, word: Column) -> Column:
        """The ids, joined by spaces, of ``word``, a string of its bytes' pieces."""

        def becomes(a: Column, b: Column) -> Column:
            return F.get(table, (F.ascii(a) * SPREAD + F.ascii(b)) % BUCKETS)[F.concat(a, b)]

        def step(state: Column, _: Column) -> Column:
            def merge(p: Column) -> Column:
                made = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), becomes)  # the last stands alone and gets null

                def join(m: Column, best: Column) -> Column:
                    # All places of one pair become the same piece, from left to right.
                    pair = let(F.array_position(m, best).cast("int"), lambda i: F.concat(F.get(p, i - 1), F.get(p, i)))
                    return F.when(best.isNull(), F.concat(state, F.lit(DONE))).otherwise(F.replace(state, pair, best))

                return let(made, lambda m: let(F.array_min(m), lambda best: join(m, best)))

            return F.when(F.endswith(state, F.lit(DONE)), state).otherwise(let(F.split(state, ""), merge))

        n = F.char_length(word)
        folded = F.when(n < 2, word).otherwise(F.rtrim(F.aggregate(F.sequence(F.lit(2), n), word, step), F.lit(DONE)))
        return F.array_join(F.transform(F.split(folded, ""), lambda c: (F.ascii(c) - self.FIRST).cast("string")), " ")

    def encode_words(self, words: Column) -> Column:
        """Ids joined by spaces for each of an array of words, strings of their bytes' pieces."""
        return let(self.table(), lambda t: F.transform(words, lambda w: self.fold(t, w)))

    def pieces(self, text: Column) -> Column:
        """A text's UTF-8 bytes as a string of pieces."""
        source = "".join(map(chr, self.bytes_to_pieces))
        return F.translate(F.decode(F.encode(text, "utf-8"), "iso-8859-1"), source, "".join(map(chr, self.bytes_to_pieces.values())))

    def decoder(self) -> list[bytes]:
        """The bytes of each id, by id."""
        pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token
        return pieces


def split(text: Column, pattern: str) -> Column:
    """The words of the whole text. With the flag, white space is Unicode's, as in the libraries that the patterns are for."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def frequent_words(texts: DataFrame, pattern: str) -> DataFrame:
    """word, n of at most ``HEAD_WORDS`` words, the most frequent that have ``HEAD_BYTES`` bytes at most, over all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch's different words are counted by Arrow
            counts = batch.column("words").flatten().value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])

    counts = texts.select(split(F.col("text"), pattern).alias("words")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession, 10_000, 16 << 20):
        return most_frequent(materialize(counts.where(F.octet_length("word") <= HEAD_BYTES)), HEAD_WORDS)


class Head:
    """The frequent words and their ids, found by binary search over hashes: three flat arrays in a file that workers map."""

    def __init__(self, data: Mapped):
        with pa.ipc.open_stream(pa.py_buffer(data.words())) as source:
            table = source.read_all()
        columns = [table.column(c) for c in ("hash", "word", "ids")]
        hashes, self.words, self.ids = (c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in columns)  # of one chunk no copy
        self.hashes = hashes.to_numpy().view(np.uint64)

    @staticmethod
    def shared(coded: DataFrame) -> Mapped:
        """(word, ids) as a file that the workers map. The hashes are Spark's, of seed ``SEED``."""
        table = coded.select("word", "ids", F.xxhash64("word").alias("hash")).toArrow().combine_chunks()
        order = np.argsort(table.column("hash").to_numpy().view(np.uint64))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table.take(pa.array(order)).combine_chunks())
        del table, order
        data = sink.getvalue().to_pybytes()
        del sink
        made = Mapped(coded.sparkSession, data)
        del data
        give_back_driver(coded.sparkSession)
        return made

    def find(self, words: pa.Array, plain: list[str]) -> list[str | None]:
        """The ids of each word, or none. Of words with equal hashes the dictionary finds the first: the others are folded."""
        if not len(self.hashes):
            return [None] * len(plain)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, plain, repeat(SEED)), dtype=np.uint64, count=len(plain))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        places = pa.array(at, mask=self.hashes[at] != hashes)
        same = pc.equal(self.words.take(places), words)
        return pc.if_else(same, self.ids.take(places), None).to_pylist()


def encode(docs: DataFrame, codec: Codec, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ids`` and ``rest`` for every row of ``docs``, which has ``text`` too: ids in decimal, joined by spaces,
    with ``~k`` for a word whose ids are element k of ``rest``.

    Each match of ``pattern`` is encoded by itself; special tokens are ordinary text. A null or empty text has no ids; repeated rows
    each have a row; an empty table gives an empty one. A match of n bytes takes n squared steps up to ``FOLD_BYTES`` bytes and
    n log n beyond.
    """
    spark = docs.sparkSession
    head = frequent_words(docs, pattern)
    give_back_driver(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = head.repartition(n).select("word", codec.encode_words(F.array(codec.pieces(F.col("word"))))[0].alias("ids"))
    of_bytes = codec.bytes_to_pieces
    with short_plans(spark):
        shared = Head.shared(coded)
    ranks = spark.sparkContext.broadcast(codec.ranks)  # as large as the vocabulary
    schema = docs.select(*keep).schema.add("ids", "string").add("rest", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head(shared)
        for whole in batches:
            lists = whole.column("words")
            for start, end in slices(lists.value_lengths().to_numpy(), SLICE, SLICE_WORDS):  # bounded memory
                batch, words = whole.slice(start, end - start), lists.slice(start, end - start)
                of_rows = words.flatten().dictionary_encode()
                own = of_rows.dictionary.to_pylist()
                found = np.array([*head.find(of_rows.dictionary, own), None], dtype=object)[:-1]
                missing = np.array([x is None for x in found], dtype=bool)
                for i in np.nonzero(missing)[0].tolist():
                    if len(own[i]) > FOLD_BYTES // 4 and len(word := own[i].encode("utf-8", "surrogatepass")) > FOLD_BYTES:
                        found[i], missing[i] = " ".join(map(str, merged(word, ranks.value))), False
                at = of_rows.indices.to_numpy(zero_copy_only=False)
                ends = np.cumsum(words.value_lengths().to_numpy())
                ids, rest = [], []
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    row = at[a:b]
                    parts = found[row].tolist()
                    places: dict[int, int] = {}
                    for i in np.nonzero(missing[row])[0].tolist():
                        parts[i] = f"~{places.setdefault(int(row[i]), len(places))}"
                    ids.append(" ".join(parts))
                    rest.append([own[w].encode("utf-8", "surrogatepass").decode("latin-1").translate(of_bytes) for w in places])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(ids, pa.string()), pa.array(rest, pa.list_(pa.string()))], names=schema.names
                )

    parts = docs.select(*keep, split(F.col("text"), pattern).alias("words")).mapInArrow(tidy(run), schema)
    return parts.withColumn("rest", codec.encode_words(F.col("rest")))


def round_trip(docs: DataFrame, codec: Codec, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The columns ``keep``, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``: see ``encode``.

    With ``with_ids`` also ids (decimal, joined by spaces). The result is a written table.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(codec.decoder())  # as large as the vocabulary
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("ids", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_id, place = pa.array(pieces.value, pa.large_binary()), re.compile(r"~(\d+)")
        for batch in batches:
            full = []
            for line, rest in zip(batch.column("ids").to_pylist(), batch.column("rest"), strict=True):
                if "~" in line:
                    own = rest.as_py()
                    line = place.sub(lambda m, own=own: own[int(m[1])], line)
                full.append(line)
            tokens = pc.split_pattern(pa.array([x or None for x in full], pa.large_string()), " ")
            # The pieces of all ids lie one after another in the buffer of what is taken.
            bytes_ = of_id.take(tokens.flatten().cast(pa.int32()))
            counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = np.frombuffer(bytes_.buffers()[1], dtype=np.int64)[ends] if len(bytes_) else np.zeros(len(ends), dtype=np.int64)
            data = memoryview(bytes_.buffers()[2] or b"")
            decoded = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            coded = [hashlib.sha256(x.encode()).hexdigest() for x in full]
            out = pa.array(full, pa.string()) if with_ids else pa.nulls(len(full), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()), out], names=schema.names
            )

    made = encode(docs, codec, pattern, keep).mapInArrow(tidy(run), schema)
    with small_batches(docs.sparkSession, SLICE, 8 << 20), short_plans(docs.sparkSession):
        return materialize(made if with_ids else made.drop("ids"))
