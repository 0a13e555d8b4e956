"""Conversations whose turns are out of order or at fault, repaired at least cost.

A turn is kept, given another role, deleted, or has an empty turn inserted beside it, so that the roles' initials read ``(s?(ua)+)?``. The
cheapest edits come from a forward Viterbi pass over four states of that grammar (nothing yet, after the system's, the user's, the
assistant's turn), each with its least (cost, audit string); inserted turns close each layer, two at most, as a third returns to a state
that had cost less. Of two audits of equal cost and state neither begins the other, so the least prefix stays least.

A long conversation is cut into pieces of ``PIECE`` turns: each gives its costs and audits from any state to any other, and a
conversation's pieces are put together in order. Only positions, digests of the repaired text and the pieces' results pass through one task for
each conversation, row by row, in memory that grows by one letter for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Turns of a piece.
PIECE = 1024
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
#: Where a role's initial leads from each state; a conversation may end in the states ``ENDS``.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
FAULTS = ("none", "blank", "duplicate", "truncated")

Layer = list[tuple[int, str] | None]


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with made faults, by the CRC-32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text = F.coalesce("text", F.lit(" "))
    return (
        rows.withColumn("_code", F.crc32(key) % 20)
        .where("_code <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_code") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
            F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 1), turn, role, text, fault (its place in ``FAULTS``) of ``rows`` (conv_id, turn, role, text).

    By turn, null first, then by role and text; equal rows follow each other, and all but the first are duplicates. Null roles and texts are empty.
    """
    named = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    again = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy("turn"))
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", 1).when(F.col("again") > 1, 2).when(~F.right(bare, F.lit(1)).rlike("[.!?]"), 3).otherwise(0)
    position = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text", "again"))
    return named.withColumn("again", again).select("conv_id", position.cast("long").alias("position"), "turn", "role", "text", fault.alias("fault"))


def _better(a: tuple[int, str] | None, cost: int, audit: str) -> tuple[int, str]:
    return (cost, audit) if a is None or (cost, audit) < a else a


def closed(layer: Layer) -> Layer:
    """With the turns that may be inserted after it."""
    for _ in range(2):
        for state, now in enumerate(list(layer)):
            if now:
                for role in NAMES:
                    if (to := NEXT[state].get(role)) is not None:
                        layer[to] = _better(layer[to], now[0] + INSERT, now[1] + "I")
    return layer


def stepped(layer: Layer, initial: str, fault: int) -> Layer:
    """The next turn's layer."""
    out: Layer = [None] * 4
    for state, now in enumerate(layer):
        if now:
            cost, audit = now
            out[state] = _better(out[state], cost + DELETE, audit + "D")
            if fault not in (1, 2):
                cost += TRUNCATED * (fault == 3)
                if (to := NEXT[state].get(initial)) is not None:
                    out[to] = _better(out[to], cost + KEEP, audit + "K")
                for role in NAMES:
                    if (to := NEXT[state].get(role)) is not None:
                        out[to] = _better(out[to], cost + REROLE, audit + "R")
    return closed(out)


def joined(layer: Layer, piece: list[Layer]) -> Layer:
    """A layer after a piece, whose layers are by the state it begins in."""
    out: Layer = [None] * 4
    for now, to in zip(layer, piece, strict=True):
        for state, then in enumerate(to):
            if now and then:
                out[state] = _better(out[state], now[0] + then[0], now[1] + then[1])
    return out


def begun() -> Layer:
    return closed([(0, ""), None, None, None])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, tuple]]:
    """Rows of batches sorted by their first columns, and whether each is the first of its key."""
    last: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[:keys] != last, row
            last = row[:keys]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pieces(rows: DataFrame) -> DataFrame:
    """conv_id, piece, and of each state it may begin in and each it may end in the cost (-1: none) and audit, from ``ordered`` rows."""
    schema = T.StructType(
        [rows.schema["conv_id"], T.StructField("piece", T.LongType()), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))]
    )
    arrow = _arrow(schema)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        layers: list[Layer] = []
        key: tuple = ()

        def told() -> tuple:
            entries = [x for layer in layers for x in layer]
            return (*key, [x[0] if x else -1 for x in entries], [x[1] if x else "" for x in entries])

        for new, (conv_id, piece, _, initial, fault) in _grouped(batches, 2):
            if new:
                if layers:
                    yield told()
                key = (conv_id, piece)
                layers = [[(0, "") if s == t else None for t in range(4)] for s in range(4)] if piece else [begun(), *([None] * 4 for _ in range(3))]
            layers = [stepped(layer, initial, fault) for layer in layers]
        if layers:
            yield told()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = rows.select("conv_id", F.floor((F.col("position") - 1) / PIECE).alias("piece"), "position", F.left("role", F.lit(1)).alias("initial"), "fault")
    return light.repartition(n, "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "position").mapInArrow(lambda b: _batches(results(b), arrow), schema)


class _Repair:
    """One conversation's pieces and then its rows, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.layer, self.best = conv_id, None, None
        self.counts, self.illegal, self.turns, self.low, self.high, self.before = [0] * 4, 0, 0, None, None, None
        self.at = self.place = self.length = 0

    def add_piece(self, costs: list[int], audits: list[str]) -> None:
        entries = [(c, a) if c >= 0 else None for c, a in zip(costs, audits, strict=True)]
        piece = [entries[k : k + 4] for k in range(0, 16, 4)]
        self.layer = piece[0] if self.layer is None else joined(self.layer, piece)

    def edits(self) -> tuple[int, str]:
        if self.best is None:
            self.best = min(x for x in (self.layer[s] for s in ENDS) if x) if self.layer else (0, "")
            self.length = sum(x != "D" for x in self.best[1])
        return self.best

    def _turn(self, edit: str, turn, role: str | None, text: str) -> tuple:
        self.place += 1
        return (self.conv_id, self.place, edit, turn, role if role is not None else NAMES["ua"[(self.place + self.length + 1) % 2]], text)

    def _inserted(self) -> Iterator[tuple]:
        audit = self.edits()[1]
        while audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn("I", None, None, "")

    def add_row(self, turn, role: str, text: str, fault: int) -> Iterator[tuple]:
        self.counts[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        yield from self._inserted()
        edit = self.edits()[1][self.at]
        self.at += 1
        if edit != "D":
            yield self._turn(edit, turn, role if edit == "K" else None, text)

    def end(self) -> Iterator[tuple]:
        yield from self._inserted()

    def summary(self, digest: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = self.edits()
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, cost, audit, digest)


def _walked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation's id, pieces and rows, one after the other."""
    rest = {"turn": "long", "role": "string", "text": "string", "fault": "int", "costs": "array<long>", "audits": "array<string>"}

    def shaped(df: DataFrame, kind: int, at: Column) -> DataFrame:
        columns = ((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in rest.items())
        return df.select("conv_id", F.lit(kind).alias("kind"), at.cast("long").alias("at"), *columns)

    parts = shaped(ids, 0, F.lit(0)).unionByName(shaped(pieces(rows), 1, F.col("piece"))).unionByName(shaped(rows, 2, F.col("position")))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "at")


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Repair, tuple | None]]:
    """Each repaired turn with its conversation's repair, and at its end the repair alone."""
    now = None
    for new, (conv_id, kind, _, turn, role, text, fault, costs, audits) in _grouped(batches, 1):
        if new:
            if now:
                yield from ((now, x) for x in now.end())
                yield now, None
            now = _Repair(conv_id)
        if kind == 1:
            now.add_piece(costs, audits)
        elif kind == 2:
            yield from ((now, x) for x in now.add_row(turn, role, text, fault))
    if now:
        yield from ((now, x) for x in now.end())
        yield now, None


def _prepared(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    numbered = materialize(ordered(rows))
    return _walked(numbered, (numbered if ids is None else ids).select("conv_id").distinct())


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit (K, R or I), turn, role, text: the turns after repair of ``rows`` (conv_id, turn, role, text).

    Turns go by number, null first, then by role and text. Other columns are left out. Rows of a null conv_id are one conversation. Null roles
    and texts are empty; repeated rows are duplicates, which go. An empty table gives an empty one.
    """
    walked = _prepared(rows, None)
    schema = T.StructType(
        [
            walked.schema["conv_id"],
            T.StructField("place", T.LongType()),
            T.StructField("edit", T.StringType()),
            T.StructField("turn", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
    arrow = _arrow(schema)
    return walked.mapInArrow(lambda b: _batches((x for _, x in _repairs(b) if x), arrow), schema)


def summaries(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: what repair found and did in each conversation.

    ``ids``: conv_id of conversations that may have lost all rows; theirs are zeros, the empty audit and the empty text's digest. The digest
    is of the repaired turns as ``role:text``, joined by line breaks. The rest is as ``repaired`` says.
    """
    walked = _prepared(rows, ids)
    schema = T.StructType(
        [
            walked.schema["conv_id"],
            *(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            T.StructField("audit", T.StringType()),
            T.StructField("repaired_sha256", T.StringType()),
        ]
    )
    arrow = _arrow(schema)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest = hashlib.sha256()
        for repair, turn in _repairs(batches):
            if turn:
                digest.update(("\n" * (turn[1] > 1) + f"{turn[4]}:{turn[5]}").encode())
            else:
                yield repair.summary(digest.hexdigest())
                digest = hashlib.sha256()

    return walked.mapInArrow(lambda b: _batches(results(b), arrow), schema)
