"""The line most alike a title, by the ratio of matching blocks, without comparing all pairs.

The ratio of two texts is twice their matching characters by their characters, so it can't be more than what their characters, as multisets, allow.
A file's lines, in blocks, meet its titles in one exchange. How often a character stands in each line is counted once for all titles of a block;
from that follow a title's bounds, and only lines whose bound is not below the best ratio so far are compared exactly, those of the highest bound first.
"""

from __future__ import annotations

import difflib
import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import sweeps

PAIR = ["file_id", "position"]
#: Lines of a file that are held at once; titles are copied to each block of a longer one.
BLOCK = 1 << 12
#: Up to so many lines of ASCII are counted in one table; SequenceMatcher ignores no character of a text shorter than ``LONG``.
TABLE, LONG = 256, 200


@functools.lru_cache(maxsize=64)
def _against(name: str) -> difflib.SequenceMatcher:
    return difflib.SequenceMatcher(None, "", name)


@functools.lru_cache(maxsize=1 << 16)
def ratio(line: str, name: str) -> float:
    """The name's side is the second sequence, whose frequent characters may be ignored."""
    matcher = _against(name)
    matcher.set_seq1(line)
    return matcher.ratio()


class Lines:
    """Some different lines, and how often each character that was asked for stands in each."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        self.counts: dict[str, np.ndarray] = {}
        self.table, whole = None, "".join(lines)
        if len(lines) <= TABLE and whole.isascii():
            codes = np.repeat(np.arange(len(lines)) * 128, self.sizes) + np.frombuffer(whole.encode(), dtype=np.uint8)
            self.table = np.bincount(codes, minlength=len(lines) * 128).reshape(-1, 128)

    def count(self, c: str) -> np.ndarray:
        if c not in self.counts:
            self.counts[c] = np.fromiter((line.count(c) for line in self.lines), dtype=np.int64, count=len(self.lines))
        return self.counts[c]

    def closest(self, name: str) -> tuple[float, str]:
        """The highest ratio, however low, and the greatest line that has it."""
        if len(name) < LONG and name in self.lines:
            return 1.0, name
        if self.table is not None:
            own = np.bincount(np.frombuffer(name.encode("ascii", "ignore"), dtype=np.uint8), minlength=128)
            shared = np.minimum(self.table, own).sum(axis=1)
        else:
            shared = np.zeros(len(self.lines), dtype=np.int64)
            for c, n in Counter(name).items():
                shared += np.minimum(self.count(c), n)
        whole = self.sizes + len(name)
        bounds = np.where(whole > 0, 2.0 * shared / np.maximum(whole, 1), 1.0)
        best = (-1.0, "")
        for i in np.argsort(-bounds, kind="stable").tolist():
            if bounds[i] < best[0]:
                break
            best = max(best, (ratio(self.lines[i], name) if bounds[i] else 0.0, self.lines[i]))
        return best


def nearest(names: Iterable[str], lines: list[str]) -> dict[str, tuple[float, str]]:
    """The highest ratio and the greatest line that has it, for each name; of no lines nothing. ``BLOCK`` lines are counted at once."""
    best: dict[str, tuple[float, str]] = {}
    for k in range(0, len(lines), BLOCK):
        held = Lines(lines[k : k + BLOCK])
        for name in names:
            found = held.closest(name)
            best[name] = max(best.get(name, found), found)
    return best


def closest(names: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, position, ord, ratio, line: of ``lines`` (file_id, ord, line), the one most alike each of ``names`` (file_id, position, name).

    The highest ratio, however low; of equals the greatest line, and its first place. A null name is empty; null lines are none. A file without lines has no row.
    """
    long, at = T.LongType(), (F.col("ord") / BLOCK).cast("long")
    said = lines.where("line is not null")
    far = said.where(F.col("ord") >= BLOCK).groupBy("file_id").agg(F.collect_set(at).alias("blocks"))
    blocks = F.array_union(F.array(F.lit(0).cast("long")), F.coalesce("blocks", F.array().cast("array<long>")))
    asked = names.where("file_id is not null").join(far, "file_id", "left").select(
        "file_id", F.explode(blocks).alias("block"), F.lit(-1).cast("long").alias("at"), F.coalesce("name", F.lit("")).alias("text"), F.col("position").cast("long").alias("position")
    )
    body = said.select("file_id", at.alias("block"), F.col("ord").cast("long").alias("at"), F.col("line").alias("text"))
    schema = T.StructType([names.schema["file_id"], T.StructField("position", long), T.StructField("ratio", T.DoubleType()), T.StructField("line", T.StringType()), T.StructField("ord", long)])

    def fold(key: tuple, group: Iterable[tuple]) -> Iterator[tuple]:
        titles: dict[str, list[int]] = {}
        firsts: dict[str, int] = {}
        for _, _, place, text, position in group:
            if position is not None:
                titles.setdefault(text, []).append(position)
            elif titles:
                firsts.setdefault(text, place)
        if firsts:
            held = Lines(list(firsts))
            for name, positions in titles.items():
                likeness, line = held.closest(name)
                yield from ((key[0], position, likeness, line, firsts[line]) for position in positions)

    found = sweeps.streamed(asked.unionByName(body, allowMissingColumns=True), ["file_id", "block"], ["at"], fold, schema)
    best = found.groupBy(*PAIR).agg(F.max(F.struct("ratio", "line", (-F.col("ord")).alias("back"))).alias("best"))
    place, kind = names.schema["position"].dataType, lines.schema["ord"].dataType
    return best.select("file_id", F.col("position").cast(place).alias("position"), (-F.col("best.back")).cast(kind).alias("ord"), "best.ratio", "best.line")
