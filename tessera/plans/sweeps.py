"""Folds over sorted rows, streamed: one exchange at most, one pass through each partition, and the memory that one key's fold needs."""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Different names of a file that are compared with each line by themselves.
FEW = 16

Fold = Callable[[tuple, Iterable[tuple]], Iterator[tuple]]


def values(column: pa.Array) -> list:
    """A column's values, of those that are there: most of a union's are null."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count:
        out, real = [None] * len(column), np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        for i, value in zip(real.tolist(), values(column.take(pa.array(real))), strict=True):
            out[i] = value
        return out
    if pa.types.is_string(column.type) or pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def streamed(rows: DataFrame, keys: list[str], order: list[str | Column], fold: Fold, schema: T.StructType, size: int = 4000) -> DataFrame:
    """What ``fold`` makes of each key's rows, which come in order, one by one. The first columns of ``rows`` are the keys.

    A window puts them in order: rows that are by one of the keys already aren't exchanged.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, width = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*map(values, batch.columns[:-1]), strict=True))
        out = (x for key, group in itertools.groupby(each, key=lambda row: row[:width]) for x in fold(key, group))
        while held := list(itertools.islice(out, size)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return rows.withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).mapInArrow(run, schema)


def _with(rows: DataFrame, first: list[str], name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    """``rows`` with ``first`` in front, and their schema with a further column."""
    ordered = rows.select(*first, *(c for c in rows.columns if c not in first))
    return ordered, T.StructType([*ordered.schema.fields, T.StructField(name, kind)])


def next_start_of_later(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the least start, beyond the own, of the file's rows of a later position; null if there is none or no own start.

    By start, it is the next row of a greater position: a stack of rows that wait for theirs.
    """
    ordered, schema = _with(rows, ["file_id", "start", "position"], name, rows.schema["start"].dataType)

    def fold(_: tuple, group: Iterable[tuple]) -> Iterator[tuple]:
        waiting: list[tuple] = []
        for row in group:
            if row[1] is None:
                yield (*row, None)
                continue
            while waiting and waiting[-1][2] < row[2]:
                yield (*waiting.pop(), row[1])
            waiting.append(row)
        yield from ((*row, None) for row in waiting)

    return streamed(ordered, ["file_id"], ["start", F.desc("position")], fold, schema).select(*rows.columns, name)


def next_start_of_other(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: the least start, beyond the own, of the file's rows of another ``key``; null if there is none or no own start.

    From the last start backwards, two rows are remembered: the nearest, and the nearest of another key than that. A null key is no other's.
    """
    ordered, schema = _with(rows, ["file_id", "start", key], name, rows.schema["start"].dataType)

    def fold(_: tuple, group: Iterable[tuple]) -> Iterator[tuple]:
        near: list[tuple] = []  # (start, key), of different keys, the nearest first
        for start, same in itertools.groupby(group, key=lambda row: row[1]):
            passed = set()
            for row in same:
                found = next((s for s, k in near if k != row[2]), None) if start is not None and row[2] is not None else None
                yield (*row, found)
                if start is not None and row[2] is not None:
                    passed.add(row[2])
            near = ([(start, k) for k in itertools.islice(sorted(passed), 2)] + [x for x in near if x[1] not in passed])[:2]

    return streamed(ordered, ["file_id"], [F.desc("start")], fold, schema).select(*rows.columns, name)


class Fits:
    """A document's headers, and where each fits first among the lines that pass: (rule, place, what comes along) or none.

    By rule: a line begins with the key (1); it begins with the number and has the name (2); it has the name (3). Up to ``FEW`` different names are asked of
    each line; more are one automaton.
    """

    def __init__(self) -> None:
        self.names: dict[str, list[int]] = {}
        self.bare: list[int] = []
        self.heads: list[tuple[str, str]] = []
        self.best: list[tuple | None] = []
        self.automaton = None

    def add(self, key: str, number: str, name: str) -> None:
        (self.names.setdefault(name, []) if name else self.bare).append(len(self.heads))
        self.heads.append((key, number))
        self.best.append(None)

    def meet(self, text: str, place: int, along: tuple = ()) -> None:
        if len(self.names) <= FEW:
            found = [i for said, which in self.names.items() if said in text for i in which]
        else:
            if self.automaton is None:
                import ahocorasick

                self.automaton = ahocorasick.Automaton()
                for said, which in self.names.items():
                    self.automaton.add_word(said, which)
                self.automaton.make_automaton()
            found = {i for _, which in self.automaton.iter(text) for i in which}
        for i in found:
            whole, first = self.heads[i]
            rule = 1 if text.startswith(whole) else 2 if first and text.startswith(first) else 3
            if self.best[i] is None or rule < self.best[i][0]:
                self.best[i] = rule, place, along
        for i in self.bare:
            if self.best[i] is None and text.startswith(self.heads[i][0]):
                self.best[i] = 1, place, along


def first_fits(heads: DataFrame, lines: DataFrame, block: int) -> DataFrame:
    """file_id, id, head, rule, ord, n: where each header fits first in each block of ``block`` lines, and the lines up to the block's end.

    ``heads``: file_id, id, key, number, name, head (a struct that goes along), and ``lines``: file_id, ord, line, all folded. A line fits as ``Fits`` has it.
    A long file's blocks are read apart; its headers are copied to each.
    """
    at = (F.col("ord") / block).cast("long")
    far = lines.where(F.col("ord") >= block).groupBy("file_id").agg(F.collect_set(at).alias("blocks"))
    blocks = F.array_union(F.array(F.lit(0).cast("long")), F.coalesce("blocks", F.array().cast("array<long>")))
    parts = heads.join(far, "file_id", "left").select("file_id", F.explode(blocks).alias("block"), F.lit(-1).cast("long").alias("at"), "key", "number", "name", "id", "head")
    body = lines.select("file_id", at.alias("block"), F.col("ord").cast("long").alias("at"), F.col("line").alias("key"))
    both = parts.unionByName(body, allowMissingColumns=True)
    long = T.LongType()
    schema = T.StructType([heads.schema["file_id"], T.StructField("id", long), heads.schema["head"], *(T.StructField(c, long) for c in ("rule", "ord", "n"))])

    def fold(key: tuple, group: Iterable[tuple]) -> Iterator[tuple]:
        fits, heads, end = Fits(), [], 0
        for _, _, place, text, number, name, own, head in group:
            if own is not None:
                fits.add(text, number, name)
                heads.append((own, head))
                continue
            end = place + 1
            if text is not None and heads:
                fits.meet(text, place)
        for head, fit in zip(heads, fits.best, strict=True):
            yield (key[0], *head, *(fit[:2] if fit else (None, None)), end)

    return streamed(both, ["file_id", "block"], ["at"], fold, schema)


def sections(heads: DataFrame, lines: DataFrame, kept: list[str], texts: bool, nearest: Callable | None) -> DataFrame:
    """file_id, head, start, stop, n, section_text and ``kept`` of the starts' lines, in one pass through each document: one row for each of ``heads``.

    ``heads``: file_id, key, number, name, head (a struct with position and section_name). ``lines``: file_id, ord, folded, line, ``kept``. A header starts
    where it fits first by ``Fits``; one that fits nowhere, with ``nearest``, at the first place of the line that this names for it, of all different lines. It
    stops at the least start of later headers beyond the own, else at ``n``. With ``texts`` or ``nearest`` a document's lines are held.
    """
    said = heads.select("file_id", F.lit(-1).cast("long").alias("at"), F.col("key").alias("folded"), "number", "name", "head")
    body = lines.select("file_id", F.col("ord").cast("long").alias("at"), "folded", *(["line"] if texts or nearest else []), *kept)
    long, hold = T.LongType(), bool(texts or nearest)
    fields = [heads.schema["file_id"], heads.schema["head"], *(T.StructField(c, long) for c in ("start", "stop", "n")), T.StructField("section_text", T.StringType())]
    schema = T.StructType([*fields, *(T.StructField(c, lines.schema[c].dataType) for c in kept)])
    none = (None,) * len(kept)

    def fold(key: tuple, group: Iterable[tuple]) -> Iterator[tuple]:
        fits, heads, held, end = Fits(), [], [], 0
        for _, place, text, number, name, head, *along in group:
            if head is not None:
                fits.add(text, number, name)
                heads.append(head)
                continue
            end = place + 1
            if not heads:
                continue
            line, along = (along[0], along[1:]) if hold else (None, along)
            if hold:
                held.append((place, line, along))
            if text is not None:
                fits.meet(text, place, along)
        starts = [fit[1:] if fit else (None, none) for fit in fits.best]
        bare = [i for i, (start, _) in enumerate(starts) if start is None]
        if nearest and bare:
            firsts: dict[str, tuple] = {}
            for place, line, along in held:
                if line is not None:
                    firsts.setdefault(line, (place, along))
            found = nearest({heads[i]["section_name"] or "" for i in bare}, list(firsts))
            for i in bare:
                if (best := found.get(heads[i]["section_name"] or "")) is not None:
                    starts[i] = firsts[best[1]]
        # By start, it is the next header of a later position: a stack of those that wait for theirs.
        stops, waiting = [end] * len(heads), []
        for i in sorted((i for i, (start, _) in enumerate(starts) if start is not None), key=lambda i: (starts[i][0], -heads[i]["position"])):
            while waiting and heads[waiting[-1]]["position"] < heads[i]["position"]:
                stops[waiting.pop()] = starts[i][0]
            waiting.append(i)
        places = [place for place, *_ in held]
        for head, (start, along), stop in zip(heads, starts, stops, strict=True):
            text = None
            if texts and start is not None:
                first, last = (bisect.bisect_left(places, x) for x in (start, stop))
                text = "\n".join(line for _, line, _ in held[first:last] if line is not None) if first < last else None
            yield (key[0], head, start, stop, end, text, *along)

    return streamed(said.unionByName(body, allowMissingColumns=True), ["file_id"], ["at"], fold, schema, 256 if texts else 4000)


def depths_below(nodes: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, a node's depth: its level, but at least one below its parent's depth.

    ``nodes``: file_id, position (in front of all below it), parent (a position or null), level. The path to a node is a stack. A parent that isn't on it
    counts as none, a null level as 1.
    """
    ordered, schema = _with(nodes, ["file_id", "position", "parent", "level"], name, T.IntegerType())

    def fold(_: tuple, group: Iterable[tuple]) -> Iterator[tuple]:
        path: list[tuple] = []  # (position, depth)
        for row in group:
            while path and path[-1][0] != row[2]:
                path.pop()
            path.append((row[1], max(path[-1][1] + 1 if path else 1, row[3] if row[3] is not None else 1)))
            yield (*row, path[-1][1])

    return streamed(ordered, ["file_id"], ["position"], fold, schema).select(*nodes.columns, name)


def paced(requests: DataFrame, spacing: float, most: int) -> DataFrame:
    """Adds ``start`` to requests (key, at, takes, in seconds): the earliest time that is ``spacing`` after the start before it and at which fewer than
    ``most`` of its key's requests are under way.

    Requests of a key start in the order they came, equal ones in any; a null ``takes`` is none. What is remembered is the ends of ``most`` requests.
    """
    ordered, schema = _with(requests, ["key", "at", "takes"], "start", T.DoubleType())

    def fold(_: tuple, group: Iterable[tuple]) -> Iterator[tuple]:
        ends: list[float] = []
        last = float("-inf")
        for row in group:
            start = max(row[1], last + spacing)
            if len(ends) == most:
                start = max(start, heapq.heappop(ends))
            heapq.heappush(ends, start + (row[2] or 0.0))
            last = start
            yield (*row, start)

    return streamed(ordered, ["key"], ["at", "takes"], fold, schema).select(*requests.columns, "start")
