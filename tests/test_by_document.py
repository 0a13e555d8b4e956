"""Queries over the derived corpus exchange its sections once, not its lines: windows over a document in place of joins."""

import pytest

from tessera.operators import atomize, lines, matching, quality
from tessera.plans import catalog

SOURCE = "/root/testdata/sf0.001"


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["clean_documents", "export_csv_b", "flat_headers", "leaf_fallback_specs", "section_tree"])
def test_lines_are_read_once(spark, name):
    assert plan(catalog.QUERIES[name](spark, SOURCE), "optimizedPlan").count("Relation [") == 2


@pytest.mark.parametrize("name", ["leaf_fallback_ranges", "section_chunks", "anchor_monotone", "qa_coverage"])
def test_lines_are_joined_by_no_text_and_no_section(spark, name):
    joins = [x for x in plan(catalog.QUERIES[name](spark, SOURCE), "optimizedPlan").splitlines() if "Join " in x and "l_partkey" not in x]
    assert len(joins) <= (name == "anchor_monotone"), joins


def test_coverage_counts_nulls_and_repeated_leaves_as_joins_did(spark):
    objects = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "file_id string")
    leaves = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("a", None), ("c", "1"), (None, "1")], "file_id string, section_id string")
    specs = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", None), ("c", "1"), (None, "1"), ("a", "9")], "file_id string, section_id string")
    found = sorted((tuple(r) for r in quality.coverage(objects, leaves, specs).collect()), key=repr)
    assert found == sorted([("a", 2, 4, 4, 0.5), ("b", 1, 0, 0, 0.0), (None, 1, 0, 0, 0.0)], key=repr)


def test_sources_of_lines_are_those_of_their_section(spark):
    rows = spark.createDataFrame([("a", "1", 2, "x"), ("a", "1", 11, "y"), ("a", "2", 3, "z"), ("a", None, 4, "n"), (None, "1", 5, "n")], "file_id string, section_id string, ord int, line string")
    expected = rows.join(atomize.section_sources(rows), ["file_id", "section_id"]).select("file_id", "section_id", "ord", "source_object_ids")
    found = atomize.with_sources(rows).select("file_id", "section_id", "ord", "source_object_ids")
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_marked_lines_are_the_repeated_ones(spark):
    rows = spark.createDataFrame([("a", "foot")] * 12 + [("a", "")] * 20 + [("a", "once"), ("a", None), ("b", "foot"), (None, "foot")], "file_id string, line string")
    marked = lines.marked_repeated(rows, "file_id").where("repeated").select("file_id", "line").distinct().collect()
    assert [tuple(r) for r in marked] == [("a", "foot")]


def test_cleaned_keeps_texts_without_lines(spark):
    docs = spark.createDataFrame([("n", None), ("e", ""), ("c", "Contents\n\n"), ("r", "xii\nii"), ("m", "Contents\nA .... 1\nB .... 2\nC .... 3\n1 Scope\nbody"), (None, "  x")], "file_id string, text string")
    found = {r.file_id: r.text for r in matching.cleaned(docs).collect()}
    assert found == {"n": None, "e": "", "c": "Contents\n\n", "r": "xii\nii", "m": "1 Scope\nbody", None: "  x"}
