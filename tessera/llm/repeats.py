"""Long repeats: bytes covered by a string of so many bytes (``Sizes.length``) that also starts earlier in the corpus.

A run-length index, built where texts that can match meet:

1. Each window of so many bytes has an anchor, the least of the hashes of its ``seed``-byte strings. Equal windows have equal anchors at
   the same place. Consecutive windows of one anchor form a segment, of less than twice as many bytes.
2. Anchors are counted over the corpus, each group of documents counting its own first; only segments of repeated anchors go on.
3. Segments meet by anchor. Equal ones are one text, of which only the first in the corpus is kept. The texts of a block are laid end to end,
   suffix-sorted, and their Burrows-Wheeler transform is run-compressed: at each run's ends it keeps the suffix (Φ and its inverse) and the
   length that it shares with its neighbour. The statistics of all other positions follow from the next sampled one, one byte at a time.
   Windows whose match is long enough are marked, unless theirs is the first start.
4. Marks go back to their documents.

Documents go by ``order`` (null first), equal ones by the hash of their text, equal rows in any order: one of them is first.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scalar, slices, text_lengths, tidy


@dataclasses.dataclass(frozen=True)
class Sizes:
    """Bytes of a window; of the strings whose least hash is its anchor; of text in a group of documents, about; of text hashed at once; of a
    block of segments with an index of its own. A block ends between anchors, and an anchor with more than ``hot`` occurrences goes by single
    windows, each with a key of its own: what a block exceeds its size by is bounded.
    """

    length: int = 100
    seed: int = 40
    group: int = 8 << 20
    piece: int = 1 << 20
    block: int = 2 << 20
    hot: int = 4096


SIZES = Sizes()
_BITS, _NONE = np.uint64(24), np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` bytes, by doubling."""
    out, done, power = None, 0, data.astype(np.uint64) + np.uint64(1)
    base, size = 0x9E3779B97F4A7C15, 1
    while size <= width:
        if width & size:
            out, done = (power.copy(), size) if out is None else (out[: len(data) - done - size + 1] * np.uint64(pow(base, size, 1 << 64)) + power[done : len(data) - size + 1], done + size)
        if 2 * size <= width:
            power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2
    return _mixed(out)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor's hash of each segment of the documents that ``data`` has end to end; fewer than 2^24 bytes."""
    length, seed = sizes.length, min(sizes.seed, sizes.length)
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = hashes(data, seed)
    at = least(((h >> _BITS) << _BITS) | np.arange(len(h), dtype=np.uint64), length - seed + 1) & _NONE
    inside = np.zeros(len(at) + 1, np.int64)
    whole = ends - starts >= length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, np.minimum(ends[whole] - length + 1, len(at)), -1)
    at = np.where(np.cumsum(inside[:-1]) > 0, at, _NONE)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    real = at[first] != _NONE
    first, last = first[real], last[real]
    return first, last, h[at[first].astype(np.int64)]


def pieces(texts: pa.Array, sizes: Sizes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes end to end, and of each text in them its row and the place of its first byte there, in parts of about ``sizes.piece``.

    A longer text is cut into parts that share ``sizes.length`` - 1 bytes, so that each window is in one part.
    """
    lengths = text_lengths(texts)
    for start, end in slices(lengths, len(lengths), sizes.piece):
        blobs = [texts[i].as_buffer() for i in range(start, end)]
        if end - start > 1 or lengths[start] <= sizes.piece:
            yield np.frombuffer(b"".join(b or b"" for b in blobs), np.uint8), np.arange(start, end), np.zeros(end - start, np.int64)
        else:
            data = np.frombuffer(blobs[0], np.uint8)
            for at in range(0, max(1, len(data) - sizes.length + 1), sizes.piece):
                yield data[at : at + sizes.piece + sizes.length - 1], np.array([start]), np.array([at])


def _segments_of(texts: pa.Array, sizes: Sizes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: bytes, and of each segment the row, its start in the part, its start in the text, its windows, its anchor."""
    lengths = text_lengths(texts)
    for data, rows, offsets in pieces(texts, sizes):
        ends = np.cumsum(lengths[rows]) if len(rows) > 1 else np.array([len(data)])
        starts = np.concatenate([[0], ends[:-1]])
        first, last, anchor = segments(data, starts, ends, sizes)
        k = np.searchsorted(ends, first, side="right")
        yield data, rows[k], first, first - starts[k] + offsets[k], last - first + 1, anchor


def _table(schema: pa.Schema, *columns) -> pa.Table:
    return pa.table([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


_ANCHORS = pa.schema([("anchor", pa.int64()), ("p", pa.int64()), ("n", pa.int64())])
_KNOWN = pa.schema([("p", pa.int64()), ("anchor", pa.int64()), ("hot", pa.bool_())])
_FOUND = pa.schema([("key", pa.int64()), ("bytes", pa.binary()), ("id", pa.int64()), ("tie", pa.int64()), ("place", pa.int64()), ("p", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])
_MARKS = pa.schema([("p", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _texts(docs: pa.Table, name: str) -> pa.Array:
    return docs["_row"].combine_chunks().field(name)


def _ordered(docs: pa.Table) -> pa.Table:
    """A group's documents in the corpus's order; the least long stands for null."""
    docs = docs.set_column(docs.schema.get_field_index("_id"), "_id", pc.fill_null(docs["_id"], -(1 << 63)))
    return docs.take(pc.sort_indices(docs, [("_id", "ascending"), ("_tie", "ascending"), ("_place", "ascending")]))


def _count_anchors(text: str, sizes: Sizes):
    def run(docs: pa.Table) -> pa.Table:
        found = [anchor for *_, anchor in _segments_of(_texts(docs, text), sizes)]
        anchor, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        return _table(_ANCHORS, anchor.view(np.int64), np.full(len(anchor), docs["_p"][0].as_py()), n)

    return run


def _repeated(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors with two occurrences or more, to each group that has one. Rows are sorted by anchor; an anchor may span batches."""
        held = None

        def told(t: pa.Table) -> pa.RecordBatch:
            a = t["anchor"].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            total = np.repeat(np.add.reduceat(t["n"].to_numpy(), cut), np.diff(np.append(cut, len(a))))
            out = _table(_KNOWN, t["p"], t["anchor"], total > hot).filter(pa.array(total > 1))
            return out.combine_chunks().to_batches()[0] if len(out) else pa.RecordBatch.from_pylist([], _KNOWN)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            a = held["anchor"].to_numpy()
            done = int(np.searchsorted(a, a[-1])) if len(a) else 0
            if done:
                yield told(held.slice(0, done))
                held = held.slice(done)
        if held is not None and len(held):
            yield told(held)

    return tidy(run)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cut_segments(text: str, sizes: Sizes):
    length = sizes.length

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        """Segments of repeated anchors, each different one once, by its first place in the group; of the others, the marks, without bytes."""
        if not len(docs) or not len(known):
            return _FOUND.empty_table()
        docs = _ordered(docs)
        order = np.argsort(known["anchor"].to_numpy().view(np.uint64))
        anchors, hot = known["anchor"].to_numpy().view(np.uint64)[order], known["hot"].to_numpy(zero_copy_only=False)[order]
        seen: set[bytes] = set()
        keys, blobs, rows_out, starts_out, windows_out = [], [], [], [], []

        def put(key: int, blob: bytes | None, row: int, start: int, windows: int) -> None:
            keys.append(key), blobs.append(blob), rows_out.append(row), starts_out.append(start), windows_out.append(windows)

        for data, rows, first, start, windows, anchor in _segments_of(_texts(docs, text), sizes):
            at = np.minimum(np.searchsorted(anchors, anchor), len(anchors) - 1)
            mine = np.flatnonzero(anchors[at] == anchor)
            raw = data.tobytes()
            again = np.zeros(len(data), bool)
            for i, f, n, key, many in zip(mine.tolist(), first[mine].tolist(), windows[mine].tolist(), anchor[mine].view(np.int64).tolist(), hot[at[mine]].tolist(), strict=True):
                blob = raw[f : f + n + length - 1]
                if blob in seen:
                    again[f : f + n] = True
                elif not many:
                    seen.add(blob)
                    put(key, blob, rows[i], start[i], n)
                else:
                    for k in range(n):
                        window = blob[k : k + length]
                        if window in seen:
                            again[f + k] = True
                        else:
                            seen.add(window)
                            put(_key(window), window, rows[i], start[i] + k, 1)
            for a, b in zip(*_runs(again), strict=True):  # of one document, as its last bytes begin no window
                i = int(np.searchsorted(first, a, side="right")) - 1
                put(_key(b"%d:%d" % (rows[i], start[i])), None, rows[i], start[i] + a - first[i], b - a)
        take = np.array(rows_out, np.int64)
        return _table(_FOUND, keys, pa.array(blobs, pa.binary()), *(docs[c].combine_chunks().take(pa.array(take)) for c in ("_id", "_tie", "_place", "_p")), np.array(starts_out, np.int64), np.array(windows_out, np.int64))

    return run


def _key(window: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(window) - (1 << 63)


def suffixes(text: np.ndarray, longest: int) -> np.ndarray:
    """The suffix array of a text whose separators are all different and at most ``longest`` symbols apart, by doubling from 4 symbols on."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(4, text.dtype)]).astype(np.uint64)
    bits = np.uint64(max(1, int(text.max()).bit_length()))
    if 4 * int(bits) <= 64:
        key, depth = ((padded[:n] << bits | padded[1 : n + 1]) << bits | padded[2 : n + 2]) << bits | padded[3 : n + 3], 4
    else:
        key, depth = padded[:n], 1
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.uint64)
        s = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        if depth > longest or rank[order[-1]] == n - 1:
            return order
        key = rank << np.uint64(32)
        key[: n - depth] |= rank[depth:] + np.uint64(1)
        depth *= 2


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of texts end to end, with the suffixes at its runs' ends and what they share with their neighbours."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1)
        n, k = int(self.ends[-1]), len(texts)
        text = np.empty(n, np.uint32)
        inside = np.ones(n, bool)
        inside[self.ends - 1] = False
        text[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32) + k
        text[~inside] = np.arange(k)
        self.text = text
        suffix = suffixes(text, int(sizes.max()) + 1)
        bwt = text[suffix - 1]
        begins = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.symbols, self.begins = bwt[begins], begins
        self.before = np.where(begins > 0, suffix[begins - 1], -1)  # the end of the run before
        self.at = suffix[begins]
        order = np.argsort(self.at)
        self.at, self.before = self.at[order], self.before[order]
        self.shared = self._common(self.at, self.before)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b`` share; separators are all different."""
        out, live = np.zeros(len(a), np.int64), np.flatnonzero(b >= 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            same = np.zeros(len(live), bool)
            inside = (x < len(self.text)) & (y < len(self.text))
            same[inside] = self.text[x[inside]] == self.text[y[inside]]
            live = live[same]
            out[live] += 1
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position, the suffix before it in order (Φ) and the symbols that both share: a sample's, moved along.

        Inside a run, the suffixes one symbol longer are neighbours too, so a position that no run begins at follows from the one before.
        The first position is sampled, as its symbol in front is the last separator, alone in its run.
        """
        positions = np.arange(len(self.text))
        sample = np.searchsorted(self.at, positions, side="right") - 1
        moved = positions - self.at[sample]
        before = self.before[sample]
        return np.where(before >= 0, before + moved, -1), self.shared[sample] - moved

    def repeated(self, length: int) -> np.ndarray:
        """Positions that begin a string of ``length`` that also begins earlier."""
        phi, shared = self.statistics()
        n = len(phi)
        linked = (shared >= length) & (phi >= 0)
        top = np.where(linked, phi, np.arange(n))
        while True:  # pointers to the first suffix in order of those that share the string
            further = top[top]
            if np.array_equal(further, top):
                break
            top = further
        first = np.arange(n)
        np.minimum.at(first, top, np.arange(n))
        return first[top] < np.arange(n)


def _mark(sizes: Sizes):
    length = sizes.length

    def block(t: pa.Table) -> pa.Table:
        """Marks of a block of segments, which has all segments of its keys."""
        p, place, start, windows = (t[c].to_numpy() for c in ("p", "place", "start", "windows"))
        plain = np.asarray(t["bytes"].is_null())
        whole = [(p[plain], place[plain], start[plain], (start + windows)[plain] + length - 1)]
        t = t.filter(pa.array(~plain))
        if len(t):
            t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("id", "tie", "place", "start")]))
            p, place, start, windows, key = (t[c].to_numpy() for c in ("p", "place", "start", "windows", "key"))
            texts: dict[bytes, int] = {}
            later = np.array([texts.setdefault(b, i) != i for i, b in enumerate(t["bytes"].to_pylist())], bool)
            whole.append((p[later], place[later], start[later], (start + windows)[later] + length - 1))
            kept = np.fromiter(texts.values(), np.int64, len(texts))
            # A text whose anchor no other has can't share a window with another.
            _, code, n = np.unique(key[kept], return_inverse=True, return_counts=True)
            several = n[code] > 1
            chosen = [b for b, x in zip(texts, several, strict=True) if x]
            if chosen:
                index, source = RunIndex(chosen), kept[several]
                flags = index.repeated(length)
                a, b = _runs(flags)
                i = np.searchsorted(index.ends, a, side="right")
                begin = np.concatenate([[0], index.ends[:-1]])[i]
                k = source[i]
                whole.append((p[k], place[k], start[k] + a - begin, start[k] + b - begin + length - 1))
        return _table(_MARKS, *(np.concatenate(c) for c in zip(*whole, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            t = pa.concat_tables(held)
            key = t["key"].to_numpy()
            done = len(t) if last else int(np.searchsorted(key, key[-1]))
            cuts = _block_ends(key[:done], text_lengths(t["bytes"])[:done], sizes.block)
            at = 0
            for cut in cuts:
                yield from block(t.slice(at, cut - at)).combine_chunks().to_batches()
                at = cut
            held = [t.slice(done)]
            size = t.slice(done)["bytes"].nbytes

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.nbytes
            if size > 2 * sizes.block:
                yield from flush(False)
        if held:
            yield from flush(True)

    return tidy(run)


def _block_ends(key: np.ndarray, lengths: np.ndarray, block: int) -> list[int]:
    """Ends of blocks of about ``block`` bytes of rows sorted by key; a key isn't cut."""
    if not len(key):
        return []
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    total = np.cumsum(lengths)[ends - 1]
    out = [int(ends[i]) for i in np.flatnonzero(np.diff(total // block)).tolist()]
    return out if out and out[-1] == len(key) else [*out, len(key)]


def _remove(text: str):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        """Each document's spans and what they leave."""
        order = np.argsort(marks["place"].to_numpy(), kind="stable")
        place, start, end = (marks[c].to_numpy()[order] for c in ("place", "start", "end"))
        spans, kept = [], []
        for at, value in zip(docs["_place"].to_pylist(), _texts(docs, text), strict=True):
            raw = np.frombuffer(value.as_buffer() if value.is_valid else b"", np.uint8)
            lo, hi = np.searchsorted(place, [at, at + 1])
            cover = np.zeros(len(raw) + 1, np.int32)
            np.add.at(cover, start[lo:hi], 1)
            np.add.at(cover, end[lo:hi], -1)
            gone = np.cumsum(cover[:-1]) > 0
            spans.append([{"start": x, "end": y} for x, y in zip(*(z.tolist() for z in _runs(gone)), strict=True)])
            kept.append(raw[~gone].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"row": docs["_row"], "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return run


def without_repeats(docs: DataFrame, text: str = "text", order: str = "doc_id", sizes: Sizes = SIZES) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, whatever their names), ``spans`` (array of start and end, in bytes: maximal runs that are
    covered by a string of ``sizes.length`` bytes that also starts earlier) and ``kept``, the bytes outside of them, for each row.

    A null text is empty. Texts shorter than that keep all. An empty table gives an empty one. Of rows that are equal in all, one is first.
    """
    total = scalar(docs.agg(F.sum(F.octet_length(text)).alias("n")))["n"] or 0
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.col(order).cast("long").alias("_id"),
        F.xxhash64(text).alias("_tie"),
        F.monotonically_increasing_id().alias("_place"),
    ).withColumn("_p", F.pmod(F.xxhash64("_place"), F.lit(max(1, total // sizes.group))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = rows.groupBy("_p")  # one exchange of the texts: what reads it three times is the same plan
    anchors = groups.applyInArrow(_count_anchors(text, sizes), "anchor long, p long, n long")
    known = anchors.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_repeated(sizes.hot), "p long, anchor long, hot boolean")
    found = groups.cogroup(known.groupBy("p")).applyInArrow(
        _cut_segments(text, sizes), "key long, bytes binary, id long, tie long, place long, p long, start long, windows long"
    )
    marks = found.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_mark(sizes), "p long, place long, start long, end long")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("row", rows.schema["_row"].dataType), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return groups.cogroup(marks.groupBy("p")).applyInArrow(_remove(text), schema)
