"""Sections in one pass through each document: what headers located, bounded and given texts one after another have, without an exchange of lines."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from test_sections import make, tables

from tessera.operators import headers, likeness, toc
from tessera.plans import catalog


@pytest.mark.parametrize(("block", "alike"), [(1 << 20, False), (1 << 20, True), (7, True)])
def test_sections_are_those_of_single_steps(spark, monkeypatch, block, alike):
    monkeypatch.setattr(headers, "BLOCK", block)
    heads, lines = make(5)
    lines += [(None, 0, "scope"), ("b", 90, "Re1ay safcty")]
    heads += [(None, 1, "1", "scope"), ("z", 1, "1", "scope"), ("b", 60, None, "rclay safety"), ("c", 70, "", None)]
    h, b = tables(spark, heads, lines)
    b = b.withColumn("line_idx", F.coalesce(F.col("ord") * 2, F.lit(0)))  # never null, unlike what comes along of headers without a start
    found = headers.located(h, b)
    bounds = headers.bounded(headers.located_by_likeness(found, b) if alike else found)
    texts = headers.section_texts(bounds, b)
    at = b.select("file_id", F.col("ord").alias("start"), "line_idx")
    expected = bounds.join(at, ["file_id", "start"], "left").join(texts, ["file_id", "position"], "left").select(*h.columns, "start", "stop", "line_idx", "section_text")
    made = headers.sections(h, b, "line_idx", texts=True, alike=alike)
    assert made.columns == expected.columns
    known = lambda rows: sorted((tuple(r) for r in rows.where("file_id is not null").collect()), key=repr)
    # A text of null lines alone was empty in one and null in the other; both are none.
    assert known(made.withColumn("section_text", F.nullif("section_text", F.lit("")))) == known(expected.withColumn("section_text", F.nullif("section_text", F.lit(""))))
    assert made.where("file_id is null").count() == 1


def test_marked_pages_are_the_contents_pages(spark):
    rng = random.Random(4)
    kinds = ["1 Scope ..... 2", "Range ... iv", "Contents", "text", "", None]
    rows = [(f, rng.choice([None, *range(12)]), i, rng.choice(kinds)) for f in "abcdefghij" for i in range(rng.randint(5, 60))]
    lines = spark.createDataFrame(rows, "file_id string, page int, line_idx int, line string")
    pages = {tuple(r) for r in toc.toc_pages(lines.where("page is not null")).collect()}
    marked = toc.marked_pages(lines).collect()
    assert len(marked) == len(rows) and {(r.file_id, r.page) for r in marked if r.contents} == pages
    assert pages and {(r.file_id, r.page) for r in marked if not r.contents}.isdisjoint(pages)


def test_closest_counts_lines_at_once_and_asks_no_equal_one(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abc 12", k=rng.randint(0, 9))) for _ in range(80)] + ["e" * 230, "ab" * 120]
    names = [*texts[::3], "zz", "", "ébc", "e" * 230, "ab" * 120]
    plain = {n: max((difflib.SequenceMatcher(None, t, n).ratio(), t) for t in texts) for n in names}
    assert likeness.nearest(names, texts) == plain
    assert likeness.nearest(names, [*texts, "é"]).keys() == plain.keys()
    monkeypatch.setattr(likeness, "TABLE", 0)
    assert likeness.nearest(names, texts) == plain
    monkeypatch.setattr(likeness, "ratio", None)
    assert likeness.Lines(["a pump", "pump"]).closest("pump") == (1.0, "pump")


def exchanged(spark, name):
    """Keys by which rows went to others, but for the corpus's own."""
    made = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    made.collect()
    ran = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [x for x in ran.splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" not in x and "hashpartitioning(l_" not in x and "hashpartitioning(p_" not in x]


@pytest.mark.parametrize("name", ["header_records", "header_locations", "section_bounds", "section_bounds_by_likeness"])
def test_lines_are_not_exchanged(spark, name):
    assert exchanged(spark, name) == []
