"""LM scoring with a log-frequency Bloom filter.

Counts of all words and of all pairs of neighbouring words of the training texts are gathered by partial sums. A count is
quantised to a power of two; an n-gram of level q is put into the filter q times, once for each level, and a reader finds
its level by probing level 1, 2, ... until one is missing. Each entry lies in one segment of fixed size, and the number of
segments grows with the entries, so that no count is left out. The filter is broadcast up to ``BROADCAST_BYTES``; beyond, it
stays a table, and blocks of documents ask its segments by a join: keys go packed to the segments and levels, a byte each, come back.

Probabilities: P(w|c) = (q(c,w) + m(c) P(w)) / (Z(c) + m(c)), where q is what the filter says of a pair, Z(c) the sum of
what it says of all pairs that c begins, and P(w) = (q(w) + 0.1) / (sum of all q + 0.1 (V + 1)). They sum to one over the vocabulary
and one unseen word, whatever quantising and false hits do to m, because both sums are taken from the filter itself, by
the tasks that build its segments. Z(c) is a whole number, kept as its binary digits. What could add to a sum is a pair that is found
without having been put in; pairs have as many probes as keep a context's expected number of those below about 2^-``SPARE``.
Three probes at a time are bits of one 64-bit word.
Pairs seen once go by P(w), at every size.

The exact base score needs exact counts of all words. The most frequent words' counts, a bounded number, go to the workers;
the other words of each document meet their counts in a join.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Mapped, discard, give_back_driver, materialize, most_frequent, packed, scalar, slices, small_batches, text_lengths, tidy

#: Probes, in threes, of a word's first level and of any entry's further levels; a pair's first level has as many as follow from the
#: logarithm of the words that can follow, and ``SPARE`` more.
WORD_PROBES, LEVEL_PROBES, SPARE = 3, 1, 7
#: The largest filter that is broadcast.
BROADCAST_BYTES = 256 << 20
#: Documents, and bytes of text, that ask a filter's table together, and training tokens for each part of the table, on the average.
BLOCK, BLOCK_BYTES, ASKED = 1_500, 4 << 20, 1 << 20
#: Rounds in which blocks ask, so that the exchanges of one round only are on the disks at once.
ROUNDS = 3
#: Words whose exact counts are broadcast. Words of more bytes than ``LONG`` go by a 128-bit hash.
HEAD_WORDS, LONG = 1 << 18, 64
#: Texts, and bytes of text, that are scored at once.
SLICE, SLICE_BYTES = 500, 2 << 20
#: Texts, and bytes of text, whose neighbours are counted at once, and rows of word counts that a task adds up before it hands them on.
COUNTED, COUNTED_BYTES, COMBINED_WORDS = 1_500, 5 << 20, 400_000
#: Keys that are looked up at once: their arrays stay in a processor's cache.
CHUNK = 1 << 14
#: Pairs that a task adds up at once, on the average at most.
PART = 1 << 18
#: What the unigram counts for in any context.
BETA = 32.0
#: The token after the last word. No word is empty.
END = b""
#: Words of 64 bits in a filter segment.
SEGMENT = 1 << 12
#: Bits of a filter for each bit that an entry sets: so half of them are set.
ROOM = 1 / math.log(2)
#: Most levels that a count can have, and digits that a sum can have.
LEVELS = 62
#: Kinds of entries.
OF_WORD, OF_PAIR, OF_CONTEXT = 0, 1, 2

_SALT = {OF_WORD: np.uint64(0x9AE16A3B2F90404F), OF_PAIR: np.uint64(0xD6E8FEB86659FD93), OF_CONTEXT: np.uint64(0xC949D7C7509E6557)}
#: XXH64's primes, from 1.
_XXH = np.array([0, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)
_SEGMENT, _GOLDEN = np.uint64(0xFF51AFD7ED558CCD), 0x9E3779B97F4A7C15


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of words of the whole texts, null as empty, and all words one after another: ASCII only, for case and white space."""
    pool = pa.system_memory_pool()  # Arrow's own keeps what is free
    low = pc.ascii_lower(pc.fill_null(texts, "") if texts.null_count else texts, memory_pool=pool)
    lists = pc.ascii_split_whitespace(low, memory_pool=pool)
    n, words = lists.value_lengths().to_numpy(), lists.flatten()
    full = pc.not_equal(words, "", memory_pool=pool)
    if pc.all(full, min_count=0).as_py():
        return n, words
    sums = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])  # white space at an end makes an empty word
    ends = np.cumsum(n)
    return sums[ends] - sums[ends - n], pc.filter(words, full, memory_pool=pool)


@dataclass(frozen=True)
class Coded:
    """Of some texts: where the tokens of each end, the names and ids of the different tokens, the end last, and each token's place among these."""

    ends: np.ndarray
    names: pa.Array
    ids: np.ndarray
    at: np.ndarray


def coded(texts: pa.Array) -> Coded:
    n, words = split(texts)
    found = pc.dictionary_encode(words, memory_pool=pa.system_memory_pool())
    names = named(found.dictionary)
    ends = np.cumsum(n + 1)
    at = np.full(int(ends[-1]) if len(ends) else 0, len(names) - 1)
    inside = np.ones(len(at), dtype=bool)
    inside[ends - 1] = False
    at[inside] = found.indices.to_numpy()
    return Coded(ends, names, word_ids(names), at)


def named(words: pa.Array) -> pa.Array:
    """Words' names, and the end."""
    names = words.cast(pa.binary())
    if pc.any(pc.greater(pc.binary_length(names), LONG)).as_py():
        names = pa.array([name(w) for w in names.to_pylist()], pa.binary())
    return pa.concat_arrays([names, pa.array([END], pa.binary())])


def name(word: bytes) -> bytes:
    """What stands for a word in tables: no word begins with a space."""
    return word if len(word) <= LONG else b" " + xxhash.xxh3_128_digest(word)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 10


def held_out(doc_id: Column) -> Column:
    """A null doc_id isn't held out."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_id(word: bytes) -> int:
    """48 bits of a hash of a word's name, so that a pair takes 12 bytes."""
    return xxhash.xxh64_intdigest(word) & 0xFFFFFFFFFFFF


def word_ids(names: pa.Array) -> np.ndarray:
    """The same of many names: those of less than 32 bytes go at once, by the steps of XXH64 for short inputs."""
    names = names.cast(pa.binary())
    if not len(names):
        return np.zeros(0, dtype=np.uint64)
    _, ends, data = names.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[names.offset : names.offset + len(names) + 1]
    data = np.concatenate([np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]], np.zeros(8, dtype=np.uint8)])
    at, n = (ends[:-1] - ends[0]).astype(np.int64), np.diff(ends)
    eights, fours = (np.ndarray(len(data) - 7, dtype=t, buffer=data, strides=(1,)) for t in ("<u8", "<u4"))
    h = n.astype(np.uint64) + _XXH[5]
    short = n < 32
    for k in (1, 2, 3):
        i = np.nonzero((n >= 8 * k) & short)[0]
        h[i] = _rotated(h[i] ^ _rotated(eights[at[i]] * _XXH[2], 31) * _XXH[1], 27) * _XXH[1] + _XXH[4]
        at[i] += 8
    i = np.nonzero(n & 4)[0]
    h[i] = _rotated(h[i] ^ fours[at[i]].astype(np.uint64) * _XXH[1], 23) * _XXH[2] + _XXH[3]
    at[i] += 4
    for k in (1, 2, 3):
        i = np.nonzero(n & 3 >= k)[0]
        h[i] = _rotated(h[i] ^ data[at[i]].astype(np.uint64) * _XXH[5], 11) * _XXH[1]
        at[i] += 1
    h = (h ^ h >> np.uint64(33)) * _XXH[2]
    h = (h ^ h >> np.uint64(29)) * _XXH[3]
    h = (h ^ h >> np.uint64(32)) & np.uint64(0xFFFFFFFFFFFF)
    h[~short] = np.fromiter(map(word_id, names.filter(pa.array(~short)).to_pylist()), dtype=np.uint64)
    return h


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def key_of(kind: int, ids: np.ndarray) -> np.ndarray:
    return mix(ids ^ _SALT[kind])


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((mix(first ^ _SALT[OF_PAIR]) + second) * np.uint64(_GOLDEN))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment in which all levels of a key are."""
    return (mix(keys ^ _SEGMENT) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)


def value(level: np.ndarray) -> np.ndarray:
    """What a level's counts 2^(q-1) to 2^q - 1 count for, a whole number: near their mean where frequencies fall as Zipf's."""
    return np.floor(1.375 * 2.0 ** (np.asarray(level) - 1)).astype(np.int64)


def places(keys: np.ndarray, level: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two times three probes of a level of the keys, from the number ``first``: words in their segments and masks."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64((level * 64 + first + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
    one, six = np.uint64(1), np.uint64(63)
    for _ in range(2):
        yield h & np.uint64(SEGMENT - 1), one << (h >> np.uint64(12) & six) | one << (h >> np.uint64(18) & six) | one << (h >> np.uint64(24) & six)
        h = h >> np.uint64(32)


@dataclass(frozen=True)
class Filter:
    """Segments ``first``, ``first`` + 1, ... of ``segments`` in all, as 64-bit words."""

    data: np.ndarray
    segments: int
    first: int = 0

    def has(self, keys: np.ndarray, base: np.ndarray, level: int, probes: int) -> np.ndarray:
        """The places of the keys that have the level: what misses by a probe isn't looked up again."""
        at = np.arange(len(keys))
        for first in range(0, probes, 2):
            for n, (word, mask) in enumerate(places(keys, level, first)):
                if first + n < probes:
                    if n:
                        word, mask = word[kept], mask[kept]
                    kept = np.nonzero(self.data[base + word] & mask == mask)[0]
                    if len(kept) < len(base):
                        at, base, keys = at[kept], base[kept], keys[kept]
        return at

    def base(self, keys: np.ndarray) -> np.ndarray:
        return (segment_of(keys, self.segments) - np.uint64(self.first)) * np.uint64(SEGMENT)

    def levels(self, keys: np.ndarray, probes: int) -> np.ndarray:
        """For each key how many levels in a row are in the filter."""
        return _by_chunks(self._levels, keys, probes)

    def _levels(self, keys: np.ndarray, probes: int) -> np.ndarray:
        out, base, at = np.zeros(len(keys), dtype=np.int64), self.base(keys), np.arange(len(keys))
        for q in range(1, LEVELS + 1):
            at = at[self.has(keys[at], base[at], q, probes if q == 1 else LEVEL_PROBES)]
            if not len(at):
                break
            out[at] = q
        return out

    def number(self, keys: np.ndarray, probes: int, digits: np.ndarray) -> np.ndarray:
        """For each key the whole number of at most so many binary digits."""
        return _by_chunks(lambda k, d: self._number(k, probes, d), keys, digits)

    def _number(self, keys: np.ndarray, probes: int, digits: np.ndarray) -> np.ndarray:
        out, base = np.zeros(len(keys), dtype=np.int64), self.base(keys)
        for d in range(int(digits.max(initial=0))):
            at = np.nonzero(digits > d)[0]
            out[at[self.has(keys[at], base[at], d + 1, probes)]] += 1 << d
        return out


def _by_chunks(f, keys: np.ndarray, more) -> np.ndarray:
    out = np.zeros(len(keys), dtype=np.int64)
    for i in range(0, len(keys), CHUNK):
        out[i : i + CHUNK] = f(keys[i : i + CHUNK], more[i : i + CHUNK] if isinstance(more, np.ndarray) else more)
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary: its ``name``; the end is empty), n: over all rows' whole texts, by partial sums of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            sums = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            held.clear()
            return pa.RecordBatch.from_arrays([sums.column("word").combine_chunks(), sums.column("n_sum").combine_chunks()], names=["word", "n"])

        for batch in batches:
            n, words = split(batch.column("text"))
            counts = pc.value_counts(words, memory_pool=pa.system_memory_pool())
            held.append(pa.table({"word": named(counts.field("values")), "n": pa.concat_arrays([counts.field("counts"), pa.array([len(n)], pa.int64())])}))
            rows += held[-1].num_rows
            if rows >= COMBINED_WORDS:
                yield out()
                rows = 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def repeated_pairs(texts: DataFrame, size: int) -> DataFrame:
    """first, second (ids of neighbouring tokens), n of all pairs that stand twice or more in the ``size`` tokens of all rows' whole texts.

    A text's start counts as an end. Partial sums are cut into parts by the pairs' keys, and a part's sums travel as one packed
    row: a task adds up those of one part, about ``PART`` pairs.
    """
    parts = max(1, math.ceil(size / PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(text_lengths(whole.column("text")), COUNTED, COUNTED_BYTES):
                yield counted(whole.column("text").slice(a, b - a))

    def counted(texts: pa.Array) -> pa.RecordBatch:
        tokens = coded(texts)
        ids, at = tokens.ids, tokens.at
        found, n = np.unique(np.concatenate([[len(ids) - 1], at[:-1]]) * np.int64(len(ids)) + at, return_counts=True)
        first, second = ids[found // len(ids)], ids[found % len(ids)]
        own = segment_of(pair_key(first, second), parts)
        order = np.argsort(own)
        own, first, second, n = own[order], first[order], second[order], n[order]
        # 48 bits of each id: 12 bytes a pair, and 4 of its number.
        packed = np.empty((len(own), 4), dtype="<u4")
        packed[:, 0], packed[:, 2], packed[:, 3] = first & np.uint64(0xFFFFFFFF), second & np.uint64(0xFFFFFFFF), np.minimum(n, 0xFFFFFFFF)
        packed[:, 1] = (first >> np.uint64(32)) | (second >> np.uint64(32) << np.uint64(16))
        starts = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
        # An array of memoryviews would keep ``packed`` for good: pyarrow never releases their buffer.
        ends = pa.array(16 * np.append(starts, len(own)), pa.int32())
        rows = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends.buffers()[1], pa.py_buffer(packed)])
        return pa.RecordBatch.from_arrays([pa.array(own[starts].astype(np.int64)), rows], names=["part", "data"])

    def added(rows: pa.Table) -> pa.Table:
        packed = np.frombuffer(b"".join(x.as_py() for x in rows.column("data")), dtype="<u4").reshape(-1, 4).astype(np.uint64)
        first = packed[:, 0] | (packed[:, 1] & np.uint64(0xFFFF)) << np.uint64(32)
        second = packed[:, 2] | packed[:, 1] >> np.uint64(16) << np.uint64(32)
        keys = pair_key(first, second)
        order = np.argsort(keys)
        starts = np.nonzero(np.concatenate([[True], (k := keys[order])[1:] != k[:-1]]))[0]
        n = np.add.reduceat(packed[order, 3], starts)
        again = n > 1
        at = order[starts[again]]
        return pa.table({"first": first[at].view(np.int64), "second": second[at].view(np.int64), "n": n[again].view(np.int64)})

    packed = texts.select("text").mapInArrow(tidy(run), "part long, data binary")
    return packed.groupBy("part").applyInArrow(added, "first long, second long, n long")


def _level(n: Column) -> Column:
    """1 for 1, 2 for 2 and 3, 3 for 4 to 7, ...; exact, as the digits of the number's binary form."""
    return F.length(F.bin(n.cast("long")))


def segments_for(bits: int) -> int:
    return max(1, math.ceil(bits * ROOM / (64 * SEGMENT)))


def entry(kind: int, keys: np.ndarray, ids: np.ndarray, level: pa.Array, segments: int) -> pa.RecordBatch:
    own = segment_of(keys, segments).astype(np.int32)
    columns = [pa.array(own), pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(ids.view(np.int64)), level]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "kind", "key", "id", "level"])


#: What a filter is built from; ``level`` is a context's number.
ENTRY = "segment int, kind int, key long, id long, level long"


def build(entries: DataFrame, segments: int, pair_probes: int) -> tuple[DataFrame, int]:
    """The segments of a filter for ``entries`` and how many there are.

    A row is either (segment, data) or (segment, id, q): the sum of what the filter says of a segment's pairs that the word ``id``
    begins, or, with id -1, of its words. A segment is built by one task from its own entries, whatever the size of the whole.
    """

    def filled(rows: pa.Table) -> pa.Table:
        data = np.zeros(SEGMENT, dtype=np.uint64)
        segment = rows.column("segment")[0].as_py()
        kind, keys, ids, level = (rows.column(c).to_numpy() for c in ("kind", "key", "id", "level"))
        keys = keys.view(np.uint64)

        def put(chosen: np.ndarray, q: int, probes: int) -> None:
            own = keys[chosen]
            for first in range(0, probes if len(own) else 0, 2):
                for n, (word, mask) in enumerate(places(own, q, first)):
                    if first + n < probes:
                        np.bitwise_or.at(data, word, mask)

        of_context, names, sums = kind == OF_CONTEXT, [], []
        for q in range(1, LEVELS + 1):
            put(of_context & (level >> (q - 1) & 1 == 1), q, pair_probes)
            for k, first in ((OF_WORD, WORD_PROBES), (OF_PAIR, pair_probes)):
                put((kind == k) & (level >= q), q, first if q == 1 else LEVEL_PROBES)
        own = Filter(data, segments, segment)
        if (kind == OF_WORD).any():
            names, sums = [-1], [int(value(own.levels(keys[kind == OF_WORD], WORD_PROBES)).sum())]
        if (kind == OF_PAIR).any():
            chosen = kind == OF_PAIR
            first, at = np.unique(ids[chosen], return_inverse=True)
            said = np.zeros(len(first), dtype=np.int64)
            np.add.at(said, at, value(own.levels(keys[chosen], pair_probes) + 1))
            names, sums = [*names, *first.tolist()], [*sums, *said.tolist()]
        n = len(names)
        return pa.table({
            "segment": pa.array([segment] * (n + 1), pa.int32()),
            "data": pa.array([data.tobytes(), *[None] * n], pa.binary()),
            "id": pa.array([None, *names], pa.int64()),
            "q": pa.array([None, *sums], pa.int64()),
        })

    return materialize(entries.groupBy("segment").applyInArrow(filled, "segment int, data binary, id long, q long")), segments


@dataclass(frozen=True)
class Numbers:
    """What the probabilities need besides the filter: training tokens, different words, the sum of what the filter says of them,
    and the binary digits of the largest context's sum.
    """

    tokens: int
    words: int
    said: int
    pair_probes: int
    digits: int


def sum_digits(said: np.ndarray) -> np.ndarray:
    """The most digits of a context's sum, ``said``: of its word. A sum has at most two digits more than it."""
    return np.where(said > 1, np.minimum(np.ceil(np.log2(np.maximum(said, 1) + 1)) + 2, LEVELS), 0).astype(np.int64)


@dataclass(frozen=True)
class Lookup:
    """What the filter says, of ids: by its own data, a filter of words and pairs and one of contexts."""

    counts: Filter
    contexts: Filter
    probes: int

    def words(self, ids: np.ndarray) -> np.ndarray:
        level = self.counts.levels(key_of(OF_WORD, ids), WORD_PROBES)
        return np.where(level > 0, value(np.maximum(level, 1)), 0)

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        level = self.counts.levels(pair_key(first, second), self.probes)
        return np.where(level > 0, value(level + 1), 0)

    def sums(self, ids: np.ndarray, said: np.ndarray) -> np.ndarray:
        return self.contexts.number(key_of(OF_CONTEXT, ids), self.probes, sum_digits(said))


@dataclass(frozen=True)
class Answers:
    """The same from answers to what a block of documents has asked: keys and numbers by kind, keys ascending."""

    given: dict[int, tuple[np.ndarray, np.ndarray]]

    def _find(self, kind: int, keys: np.ndarray) -> np.ndarray:
        known, numbers = self.given[kind]
        if not len(known):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, numbers[at], 0)

    def words(self, ids: np.ndarray) -> np.ndarray:
        return self._find(OF_WORD, key_of(OF_WORD, ids))

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self._find(OF_PAIR, pair_key(first, second))

    def sums(self, ids: np.ndarray, said: np.ndarray) -> np.ndarray:
        """As many digits as a reader of the filter asks for: further ones are false hits."""
        return self._find(OF_CONTEXT, key_of(OF_CONTEXT, ids)) & ((np.int64(1) << sum_digits(said)) - 1)


def weights(words: np.ndarray, lookup: Lookup | Answers) -> tuple[np.ndarray, np.ndarray]:
    """What the filter says of words and, as contexts, of all their pairs."""
    said = lookup.words(words)
    return said, lookup.sums(words, said)


def log10_probabilities(words: np.ndarray, at: np.ndarray, lookup: Lookup | Answers, numbers: Numbers, known: tuple | None = None) -> np.ndarray:
    """log10 P(token | token before it) for tokens of whole texts: ``words`` are different words' ids, the end's last, ``at`` their places,
    ``known`` their ``weights``, where the caller has them.
    """
    said, total = known or weights(words, lookup)
    single = (said + 0.1) / (numbers.said + 0.1 * (numbers.words + 1))
    free = BETA + np.maximum(said - total, 0)
    first, second = np.concatenate([[len(words) - 1], at[:-1]]), at
    pair = np.zeros(len(first), dtype=np.int64)
    # A pair that was put in has a context with a sum, and two words of two or more.
    likely = np.nonzero((total[first] > 0) & (said[second] > 1))[0]
    different, back = np.unique(first[likely] * np.int64(len(words)) + second[likely], return_inverse=True)
    pair[likely] = lookup.pairs(words[different // len(words)], words[different % len(words)])[back]
    return np.log10((pair + free[first] * single[second]) / (total[first] + free[first]))


@dataclass(frozen=True)
class Trained:
    vocabulary: DataFrame
    counts: tuple[DataFrame, int]
    contexts: tuple[DataFrame, int]
    numbers: Numbers


def train(texts: DataFrame) -> Trained:
    """Counts, filter and vocabulary (word, n) from all rows of ``texts`` (text; null is empty). An empty table gives an empty filter."""
    with small_batches(texts.sparkSession, COUNTED, COUNTED_BYTES):
        vocabulary = materialize(word_counts(texts))
        size = scalar(vocabulary.agg(F.sum("n")))[0] or 0
        repeated = materialize(repeated_pairs(texts, size))
    level = _level(F.col("n")).cast("long")
    of_words = scalar(vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.sum(F.when(level > 1, 1).otherwise(0)).alias("repeated"), F.sum(3 * (WORD_PROBES + LEVEL_PROBES * (level - 1))).alias("bits")))
    probes = math.ceil((max(1, of_words["repeated"] or 0).bit_length() + SPARE) / 3)
    of_pairs = scalar(repeated.agg(F.sum(3 * (probes + LEVEL_PROBES * (level - 2))).alias("bits")))

    segments = segments_for((of_words["bits"] or 0) + (of_pairs["bits"] or 0))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = word_ids(batch.column("word"))
            yield entry(OF_WORD, key_of(OF_WORD, ids), ids, batch.column("level"), segments)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(c).to_numpy().view(np.uint64) for c in ("first", "second"))
            yield entry(OF_PAIR, pair_key(first, second), first, batch.column("level"), segments)

    single = vocabulary.select("word", level.alias("level")).mapInArrow(tidy(words), ENTRY)
    double = repeated.select("first", "second", (level - 1).alias("level")).mapInArrow(tidy(pairs), ENTRY)
    counts = build(single.unionByName(double), segments, probes)
    discard(repeated)
    sums = counts[0].where("id is not null").groupBy("id").agg(F.sum("q").alias("level"))
    said = scalar(sums.where("id = -1").agg(F.sum("level")))[0] or 0
    totals = materialize(sums.where("id <> -1"))
    ones, largest = scalar(totals.agg(F.sum(F.bit_count("level")), F.max("level")))
    own = segments_for(3 * probes * (ones or 0))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy().view(np.uint64)
            yield entry(OF_CONTEXT, key_of(OF_CONTEXT, ids), ids, batch.column("level"), own)

    return Trained(vocabulary, counts, build(totals.mapInArrow(tidy(contexts), ENTRY), own, probes), Numbers(of_words["n"] or 0, of_words["words"] or 0, said, probes, (largest or 0).bit_length()))


def whole_filter(table: DataFrame, segments: int) -> bytes:
    """A filter's bytes on the driver: ``BROADCAST_BYTES`` at most, by the caller's check."""
    data = bytearray(segments * SEGMENT * 8)
    for r in table.where("data is not null").select("segment", "data").toLocalIterator():
        data[r["segment"] * SEGMENT * 8 : (r["segment"] + 1) * SEGMENT * 8] = r["data"]
    return bytes(data)


_RESULT = "n_tokens long, n_known long, logs double, score double, rest array<struct<word:binary,tf:long>>"


class Head:
    """Exact counts of the most frequent words, found by binary search over their ids, as logarithms for the base score.

    What the filter says of these words is asked once by each reader, when it first meets them: most words of any text are among them.
    """

    def __init__(self, data: bytes):
        with pa.ipc.open_stream(data) as source:
            table = source.read_all()
        self.ids, self.words = table.column("id").to_numpy().astype(np.uint64), table.column("word").combine_chunks()
        self.logs = np.log10(np.append(table.column("n").to_numpy(), 0) + 0.1)
        self.said, self.total = np.full((2, len(self.logs)), -1)  # the last is no word's, and stays unknown

    @staticmethod
    def packed(vocabulary: DataFrame) -> bytes:
        with pa.ipc.open_stream(packed(most_frequent(vocabulary, HEAD_WORDS).select("word", "n"))) as source:
            table = source.read_all()
        table = table.combine_chunks()
        ids = word_ids(table.column("word").combine_chunks())
        sink, table = pa.BufferOutputStream(), table.append_column("id", pa.array(ids)).sort_by("id").combine_chunks()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def places(self, ids: np.ndarray, words: pa.Array) -> np.ndarray:
        """Each word's place, or -1. Of words with equal ids the first is found: the others' counts meet them in the join."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        hit = self.ids[at] == ids
        hit[hit] = pc.equal(self.words.take(pa.array(at[hit])), words.filter(pa.array(hit))).to_numpy(zero_copy_only=False)
        return np.where(hit, at, -1)

    def weights(self, ids: np.ndarray, place: np.ndarray, lookup: Lookup | Answers) -> tuple[np.ndarray, np.ndarray]:
        said, total = self.said[place], self.total[place]
        new = np.nonzero(said < 0)[0]
        said[new], total[new] = weights(ids[new], lookup)
        kept = new[place[new] >= 0]
        self.said[place[kept]], self.total[place[kept]] = said[kept], total[kept]
        return said, total

    def scored(self, texts: Coded, lookup: Lookup | Answers, numbers: Numbers) -> list[pa.Array]:
        """n_tokens, n_known, logs, score, rest of some texts: their different words are looked up once."""
        ends, words, ids, at = texts.ends, texts.names, texts.ids, texts.at
        n = np.diff(ends, prepend=0)
        starts = ends - n
        place = self.places(ids, words)
        known = place >= 0
        of_word = np.where(known, self.logs[place], 0.0)
        p = log10_probabilities(ids, at, lookup, numbers, self.weights(ids, place, lookup))
        rare = np.nonzero(~known[at])[0]
        pairs_, tf = np.unique(np.searchsorted(ends, rare, side="right") * len(words) + at[rare], return_counts=True)
        offsets = np.searchsorted(pairs_, np.arange(len(n) + 1) * len(words)).astype(np.int32)
        structs = pa.StructArray.from_arrays([words.take(pa.array(pairs_ % len(words))), pa.array(tf, pa.int64())], names=["word", "tf"])
        return [
            pa.array(n, pa.int64()),
            pa.array(np.add.reduceat(known[at].astype(np.int64), starts)),
            pa.array(np.add.reduceat(of_word[at], starts)),
            pa.array(np.add.reduceat(p, starts)),
            pa.ListArray.from_arrays(pa.array(offsets), structs),
        ]


def _parts(placed: DataFrame, model: Trained, head: bytes) -> DataFrame:
    """doc_id and the columns of ``_RESULT`` with the whole filter in every worker."""
    numbers = model.numbers
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast(head)
    filters = [(Mapped(spark, whole_filter(*x)), x[1]) for x in (model.counts, model.contexts)]
    schema, kept = _schema(placed), placed.drop("text").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Head(shared.value)
        lookup = Lookup(*(Filter(data.words(), n) for data, n in filters), numbers.pair_probes)
        for whole in batches:
            for start, end in slices(text_lengths(whole.column("text")), SLICE, SLICE_BYTES):  # bounded memory
                batch = whole.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own.scored(coded(batch.column("text")), lookup, numbers)], names=schema.names)

    return placed.mapInArrow(tidy(run), schema)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers, ascending: numpy's own (2.3) takes a hash table, which cost as much as twenty sorts."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


@dataclass(frozen=True)
class Parts:
    """How a filter's table is cut for joins: ``per`` segments a part, those of the contexts after those of the counts."""

    segments: dict[int, int]
    per: int

    @property
    def shift(self) -> int:
        return math.ceil(self.segments[OF_PAIR] / self.per)

    def questions(self, texts: Coded) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """What some texts ask, whatever their order: for each kind the parts and keys, by part and then by key, each key once."""
        ids, at = texts.ids, texts.at
        pairs = distinct(np.concatenate([[len(ids) - 1], at[:-1]]) * np.int64(len(ids)) + at)
        keys = {OF_WORD: key_of(OF_WORD, ids), OF_CONTEXT: key_of(OF_CONTEXT, ids), OF_PAIR: pair_key(ids[pairs // len(ids)], ids[pairs % len(ids)])}
        out = {}
        for kind, own in keys.items():
            own = distinct(own)
            part = (segment_of(own, self.segments[kind]) // np.uint64(self.per)).astype(np.int64) + (self.shift if kind == OF_CONTEXT else 0)
            order = np.argsort(part, kind="stable")
            out[kind] = part[order], own[order]
        return out

    def filter(self, part: int, kind: int, rows: pa.Table) -> Filter:
        """A part's own segments from ``rows`` (segment, data); segments without entries have no row."""
        first = (part - self.shift if kind == OF_CONTEXT else part) * self.per
        data = np.zeros(self.per * SEGMENT, dtype=np.uint64)
        for segment, own in zip(rows.column("segment").to_pylist(), rows.column("data"), strict=True):
            data[(segment - first) * SEGMENT : (segment - first + 1) * SEGMENT] = np.frombuffer(own.as_buffer(), dtype=np.uint64)
        return Filter(data, self.segments[kind], first)


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that are consecutive stretches of an array, which end at ``ends`` (numbers of its items)."""
    offsets = pa.array(np.concatenate([[0], ends]) * data.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))])


def _parts_by_block(docs: DataFrame, model: Trained, head: bytes) -> DataFrame:
    """The same, written, where the filter stays a table: each block of documents asks for its different words and pairs, once each.

    Texts are exchanged once, by block; a block's keys for a part of the table travel as one row, and so do the answers, in the keys' order,
    which the block makes again from its texts. Blocks are dealt out to rounds; what a round exchanged goes before the next.
    """
    numbers = model.numbers
    shared = docs.sparkSession.sparkContext.broadcast(head)
    schema, kept = _schema(docs), docs.drop("text").columns
    sizes = {OF_WORD: model.counts[1], OF_PAIR: model.counts[1], OF_CONTEXT: model.contexts[1]}
    parts = Parts(sizes, max(1, (model.counts[1] + model.contexts[1]) * ASKED // max(1, numbers.tokens)))
    rows, size = scalar(docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))))
    n_blocks = max(1, math.ceil(rows / BLOCK), math.ceil((size or 0) / BLOCK_BYTES))
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))
    packed_schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
    in_spark = "block long, part long, kind int, data binary"

    def ask(docs: pa.Table) -> pa.Table:
        block, out = docs.column("block")[0], []
        for kind, (part, keys) in parts.questions(coded(docs.column("text").combine_chunks())).items():
            starts = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
            n = len(starts)
            out.append(pa.table([pa.array([block.as_py()] * n, pa.int64()), pa.array(part[starts]), pa.array([kind] * n, pa.int32()), _binaries(keys, np.append(starts[1:], len(keys)))], schema=packed_schema))
        return pa.concat_tables(out)

    def answer(asked: pa.Table, segments: pa.Table) -> pa.Table:
        out = []
        for kind in sorted(set(asked.column("kind").to_pylist())):
            rows = asked.filter(pc.equal(asked.column("kind"), kind))
            own = parts.filter(rows.column("part")[0].as_py(), kind, segments)
            data = rows.column("data").to_pylist()
            keys = np.frombuffer(b"".join(data), dtype=np.uint64)
            if kind == OF_CONTEXT:
                said = own.number(keys, numbers.pair_probes, np.full(len(keys), numbers.digits))
            else:
                said = own.levels(keys, WORD_PROBES if kind == OF_WORD else numbers.pair_probes).astype(np.uint8)
            given = _binaries(said, np.cumsum([len(d) // 8 for d in data]))
            out.append(pa.table([*(rows.column(c) for c in ("block", "part", "kind")), given], schema=packed_schema))
        return pa.concat_tables(out) if out else packed_schema.empty_table()

    def scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts, answers, given = coded(docs.column("text").combine_chunks()), answers.sort_by("part"), {}
        for kind, (_, keys) in parts.questions(texts).items():
            data = b"".join(answers.filter(pc.equal(answers.column("kind"), kind)).column("data").to_pylist())
            if kind == OF_CONTEXT:
                q = np.frombuffer(data, dtype=np.int64)
            else:
                level = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
                q = np.where(level > 0, value(np.maximum(level + (kind == OF_PAIR), 1)), 0)
            order = np.argsort(keys)
            given[kind] = keys[order], q[order]
        columns = Head(shared.value).scored(texts, Answers(given), numbers)
        return pa.table([*(docs.column(c) for c in kept), *columns], names=schema.names)

    def cut(table: DataFrame, shift: int) -> DataFrame:
        return table.where("data is not null").select((F.floor(F.col("segment") / parts.per) + shift).cast("long").alias("part"), "segment", "data")

    table = cut(model.counts[0], 0).unionByName(cut(model.contexts[0], parts.shift))

    def made(own: DataFrame, k: int) -> DataFrame:
        asked = own.groupBy("block").applyInArrow(lambda docs: tidied(ask, docs), in_spark)
        answers = asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(lambda asked, segments: tidied(answer, asked, segments), in_spark)
        given = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda docs, answers: tidied(scored, docs, answers), schema)
        return materialize(given.withColumn("place", F.monotonically_increasing_id() + F.lit(k << 58)))

    out = []
    for k in range(min(ROUNDS, n_blocks)):
        give_back_driver(docs.sparkSession)  # exchanges go with what refers to them, those of the counts first
        out.append(made(blocks.where(F.col("block") % ROUNDS == k), k))
    return functools.reduce(DataFrame.unionByName, out)


def tidied(made: Callable, *groups: pa.Table) -> pa.Table:
    """What ``made`` makes of one or two groups, with ``tidy``'s bounds for a worker's memory."""
    return next(tidy(lambda given: iter([made(*given)]))(groups))


def _schema(placed: DataFrame):
    schema = placed.drop("text").schema
    for field in placed.sparkSession.createDataFrame([], _RESULT).schema:
        schema = schema.add(field)
    return schema


def score(docs: DataFrame, model: Trained) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    A null or empty text is one end token; repeated rows each have a row; without training rows all counts are 0. An unseen
    word has the probability of one symbol, ``P`` of a count of 0.
    """
    head = Head.packed(model.vocabulary)
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    size = (model.counts[1] + model.contexts[1]) * SEGMENT * 8
    with small_batches(docs.sparkSession, SLICE, SLICE_BYTES):
        if size <= BROADCAST_BYTES:
            part = materialize(_parts(marked.withColumn("place", F.monotonically_increasing_id()), model, head))
        else:
            part = _parts_by_block(marked, model, head)
    numbers = model.numbers
    rare = part.select("place", F.inline("rest")).join(model.vocabulary, "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    exact = rare.groupBy("place").agg(
        F.sum(F.col("tf") * F.log10(n + 0.1)).alias("more"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("known")
    )
    below = math.log10(numbers.tokens + 0.1 * (numbers.words + 1))
    return part.drop("rest").join(exact, "place", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(numbers.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        "score",
    )
