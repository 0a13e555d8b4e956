"""Unified differences of documents' lines between two tables, for those documents that differ."""

from __future__ import annotations

import bisect
import difflib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a stretch that are compared by longest matches; a longer one is cut at lines that both sides have once.
STRETCH = 2000
#: Equal lines shown around a change.
CONTEXT = 3

Opcode = tuple[str, int, int, int, int]


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of lines that are once in each side, the longest ascending row of them."""
    once = [{x for x, n in Counter(side).items() if n == 1} for side in (a, b)]
    at = {x: j for j, x in enumerate(b) if x in once[0] and x in once[1]}
    ends: list[int] = []
    last: list[int] = []
    pairs = [(i, at[x]) for i, x in enumerate(a) if x in at]
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect.bisect_left(ends, j)
        before[k] = last[place - 1] if place else -1
        ends[place : place + 1], last[place : place + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _stretch(a: list[str], b: list[str], i: int, j: int) -> list[Opcode]:
    """Edits of a stretch that begins at ``i`` and ``j``."""
    if len(a) <= STRETCH and len(b) <= STRETCH:
        return [(tag, i + w, i + x, j + y, j + z) for tag, w, x, y, z in difflib.SequenceMatcher(None, a, b).get_opcodes()]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out: list[Opcode] = [("equal", i, i + head, j, j + head)] if head else []
    if head or tail:
        out += _stretch(a[head : len(a) - tail], b[head : len(b) - tail], i + head, j + head)
        return out + ([("equal", i + len(a) - tail, i + len(a), j + len(b) - tail, j + len(b))] if tail else [])
    marks = _anchors(a, b)
    if not marks:
        kind = "replace" if a and b else "delete" if a else "insert"
        return [(kind, i, i + len(a), j, j + len(b))] if a or b else []
    w = y = 0
    for x, z in [*marks, (len(a), len(b))]:
        out += _stretch(a[w:x], b[y:z], i + w, j + y)
        if x < len(a):
            out.append(("equal", i + x, i + x + 1, j + z, j + z + 1))
        w, y = x + 1, z + 1
    return out


def edits(a: list[str], b: list[str]) -> list[Opcode]:
    """What makes ``b`` of ``a``, as longest matches tell it; neighbours of one kind are one."""
    out: list[Opcode] = []
    for tag, *place in _stretch(a, b, 0, 0):
        if out and out[-1][0] == tag:
            out[-1] = (tag, out[-1][1], place[1], out[-1][3], place[3])
        else:
            out.append((tag, *place))
    return out


def unified(a: list[str], b: list[str], old: str, new: str) -> str:
    """The unified difference, empty if there is none."""
    matcher = difflib.SequenceMatcher(None, [], [])
    matcher.opcodes = edits(a, b)

    def span(start: int, stop: int) -> str:
        n = stop - start
        return f"{start + 1}" if n == 1 else f"{start + bool(n)},{n}"

    out = []
    for group in matcher.get_grouped_opcodes(CONTEXT) if any(x[0] != "equal" for x in matcher.opcodes) else ():
        out.append(f"@@ -{span(group[0][1], group[-1][2])} +{span(group[0][3], group[-1][4])} @@")
        for tag, w, x, y, z in group:
            out += [f" {line}" for line in a[w:x]] if tag == "equal" else [*(f"-{line}" for line in a[w:x]), *(f"+{line}" for line in b[y:z])]
    return "\n".join([f"--- {old}", f"+++ {new}", *out]) if out else ""


def line_diffs(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """file_id, diff of the documents whose lines (file_id, ord, line) differ between ``recorded`` and ``now``; a document may be on one side only.

    Equal documents are found by sums of their lines' hashes, which need no order, and aren't read again; only those that differ are compared, each as a
    group of its own lines. Null lines are empty.
    """

    def sums(lines: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(F.col("rank"), F.coalesce("line", F.lit("")))
        ranked = lines.selectExpr("file_id", "line", "row_number() over (partition by file_id order by ord, line) as rank")
        return ranked.groupBy("file_id").agg(F.struct(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).alias(name))

    differing = sums(now, "x").join(sums(recorded, "y"), "file_id", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("file_id")
    mine, theirs = (t.select("file_id", "ord", F.coalesce("line", F.lit("")).alias("line")).join(differing, "file_id", "left_semi") for t in (recorded, now))

    def run(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        a, b = (t.sort_by([("ord", "ascending"), ("line", "ascending")])["line"].to_pylist() for t in (old, new))
        return pa.table({"file_id": [key[0].as_py()], "diff": [unified(a, b, "recorded", "now")]}, schema=pa.schema([old.schema.field("file_id"), ("diff", pa.string())]))

    kind = now.schema["file_id"].dataType.simpleString()
    return mine.groupBy("file_id").cogroup(theirs.groupBy("file_id")).applyInArrow(run, f"file_id {kind}, diff string")
