"""Documents put together again: small cases that the tables haven't."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import documents, export
from tessera.sources import files, sinks


def test_renamed(spark):
    rows = spark.createDataFrame([("1", None, "a", None, None), (None, 2, None, "b", "c")], "section string, sectionNumber int, section_title string, text string, spec_text string")
    assert [tuple(r) for r in documents.renamed(rows).collect()] == [("1", "a", "", ""), ("2", "", "c", "")]


def test_chunks(spark):
    chunks = spark.createDataFrame([("f", "s", ["b", "zz", "a", "b"]), ("f", "t", None), ("f", "u", ["zz"])], "file_id string, section_id string, object_ids array<string>")
    objects = spark.createDataFrame([("f", "a", "A"), ("f", "b", "B"), ("g", "a", "other")], "file_id string, object_id string, text string")
    assert [tuple(r) for r in documents.chunk_texts(chunks, objects).collect()] == [("f", "s", 3, "B\nA\nB")]


def test_header_records(spark):
    """Contents lines don't count; a document of contents alone keeps them; lines without pages; headers of no line."""
    lines = [
        ("f", 0, "Contents", 0, 0), ("f", 1, "1 Scope ..... 2", 0, 1), ("f", 2, "2 Range ..... 3", 0, 2), ("f", 3, "x ..... 3", 0, 3), ("f", 4, "1 Scope", 1, 0), ("f", 5, "text", 1, 1), ("f", 6, "2 Range", 2, None),
        ("g", 0, "1 Scope ..... 2", 0, None), ("h", 0, "words", None, None), ("h", 1, "1 Scope", None, None),
    ]
    heads = [("f", 1, "1", "Scope"), ("f", 2, "2", "Range"), ("g", 1, "1", "Scope"), ("h", 1, "1", "Scope"), ("h", 2, "9", "Absent")]
    b = spark.createDataFrame(lines, "file_id string, ord int, line string, page int, line_idx int")
    h = spark.createDataFrame(heads, "file_id string, position int, section_number string, section_name string")
    plain = {(r.file_id, r.position): (r.page_number, r.line_number, r.chunk_text) for r in documents.header_records(h, b, likeness=False).collect()}
    assert plain == {
        ("f", 1): (2, 1, "1 Scope\ntext"), ("f", 2): (3, 3, "2 Range"), ("g", 1): (1, 1, "1 Scope ..... 2"), ("h", 1): (None, 2, "1 Scope"), ("h", 2): (None, None, "9 Absent"),
    }
    alike = {(r.file_id, r.position): r.chunk_text for r in documents.header_records(h, b).collect()}
    assert alike["h", 2] in ("words\n1 Scope", "1 Scope", "words")


def test_prompts(spark):
    rows = spark.createDataFrame([("", "Scope {x}", "t" * 20_000), ("2", None, None)], "section_number string, section_name string, section_text string")
    found = documents.section_prompts(rows, "Of {section_name} ({section_number}):\n{section_text}!").collect()
    assert found[0].prompt == "Of Scope {x} (N/A):\n" + "t" * 10_000 + "!" and found[1].prompt == "Of  (2):\n!"
    with pytest.raises(ValueError, match="substring not found"):
        documents.filled("nothing", name=F.lit(1))


def test_payloads_traces_chunk_lists(spark, tmp_path):
    specs = spark.createDataFrame([("s1", "f", "x", None, "T", "é \"q\"", 0.9, ["o"])], "spec_id string, file_id string, section_id string, section_number string, section_title string, spec_text string, confidence double, source_object_ids array<string>")
    sections = spark.createDataFrame([("f", 2, "B"), ("f", 1, "A"), ("g", 1, "C")], "file_id string, position int, title string")
    told = {r.file_id: json.loads(r.payload) for r in export.whole_payloads(specs, sections).collect()}
    assert [x["title"] for x in told["f"]["sections"]] == ["A", "B"] and told["f"]["specs"][0]["section_number"] is None and told["g"]["specs"] == []
    sinks.write_traces(spark.createDataFrame([("f", "k" * 300, "v")], "file_id string, text string, api_key string"), f"{tmp_path}/traces")
    (row,) = spark.read.json(f"{tmp_path}/traces").collect()
    assert row.api_key == "***" and len(row.text) == 203 and row.file_id == "f"
    (tmp_path / "chunks.json").write_text(json.dumps([{"section_id": "s", "header_path": "A / B", "depth": 2, "object_ids": ["1", 2]}, {"section_id": "t"}, {"depth": 1}]))
    found = {r.section_id: (r.header_path, r.depth, r.object_ids) for r in files.read_chunks(spark, f"{tmp_path}/chunks.json").collect()}
    assert found == {"s": ("A / B", 2, ["1", "2"]), "t": ("t", 0, [])}
