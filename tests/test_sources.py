"""Readers, writers and streams on files made here."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, sinks
from tessera.streaming import extraction, progress

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\n\n two\nthree\n")
    (tmp_path / "in/b.exe").write_text("x")
    body = p("First") + p("") + p("Second") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('c')}</w:tc><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "in/c.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return tmp_path


def test_files(spark, folder):
    found = files.binary(spark, str(folder / "in"))
    assert {r.extension: r.problem for r in found.collect()} == {"txt": None, "exe": "extension", "docx": None}
    txt = found.where("extension = 'txt'")
    every = sorted(files.text_objects(txt).collect(), key=lambda r: r.order_index)
    assert [(r.text, r.is_blank, r.line_index) for r in every] == [("one", False, 0), ("", True, 1), (" two", False, 2), ("three", False, 3)]
    dense = sorted(files.text_objects(txt, keep_blank=False).collect(), key=lambda r: r.order_index)
    assert [(r.order_index, r.line_index, r.text) for r in dense] == [(0, 0, "one"), (1, 2, " two"), (2, 3, "three")]
    docx = found.where("extension = 'docx'")
    assert [(r.kind, r.text) for r in files.docx_objects(docx).orderBy("order_index").collect()] == [("para", "First"), ("para", "Second"), ("table", "a\tb\nc\t")]
    assert files.docx_objects(docx, joined=False).orderBy("order_index").collect()[2].text == "a, b\nc"
    assert json.loads(files.docx_objects(docx, joined=False).orderBy("order_index").collect()[2].metadata["rows"]) == [["a", "b"], ["c", ""]]
    with pytest.raises(NotImplementedError):
        files.pdf_objects(found)
    assert files.pdf_objects(txt, lambda b: [{"text": "page", "page_index": 0}]).first().text == "page"


def test_markdown_and_blocks(spark, tmp_path):
    df = spark.createDataFrame([("f", bytearray(b"# Title #\n\nbody\n"))], "file_id string, content binary")
    assert [(r.kind, r.text) for r in files.markdown_objects(df).orderBy("order_index").collect()] == [("header", "Title"), ("para", "body")]
    blocks = spark.createDataFrame(
        [("f", "1", "Title", " A ", [0.0, 1.0, 2.0, 3.0], 0), ("f", "2", "image", "", None, 1), ("f", "x", "text", "b", [1.0], 2)],
        "file_id string, page string, type string, text string, bbox array<double>, ord int",
    )
    found = files.block_objects(blocks).orderBy("order_index").collect()
    assert [(r.kind, r.text, r.page_index) for r in found] == [("header", "A", 0), ("figure", None, 1), ("para", "b", None)]
    assert found[0].bbox == [0.0, 1.0, 2.0, 3.0] and found[2].bbox is None
    (tmp_path / "chunks.json").write_text(json.dumps({"s1": ["a", "b"], "s2": []}))
    assert {r.section_id: r.object_ids for r in files.read_chunks(spark, str(tmp_path / "chunks.json")).collect()} == {"s1": ["a", "b"], "s2": []}


def test_words_and_recognition(spark):
    words = spark.createDataFrame(
        [("f", 0, 1, 10.04, 50.0, 60.0, 20.0, "b"), ("f", 0, 1, 10.01, 10.0, 20.0, 21.0, "a"), ("f", 0, 2, 30.0, 10.0, 20.0, 40.0, "c")],
        "file_id string, page_index int, line_no int, top double, x0 double, x1 double, bottom double, text string",
    )
    assert [(r.text, r.bbox) for r in files.word_lines(words).orderBy("order_index").collect()] == [("a b", [10.0, 10.01, 60.0, 21.0]), ("c", [10.0, 30.0, 20.0, 40.0])]
    schema = "file_id string, page_no int, y0 double, x0 double, text string"
    have = spark.createDataFrame([("f", 0, 1.0, 1.0, "x")], schema)
    more = spark.createDataFrame([("f", 0, 5.0, 1.0, "no"), ("f", 1, 5.0, 1.0, "yes")], schema)
    pages = spark.createDataFrame([("f", 0), ("f", 1)], "file_id string, page_no int")
    assert [r.text for r in files.with_recognized(have, pages, more).orderBy("line_idx").collect()] == ["x", "yes"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    sinks.write_jsonl(df, f"{tmp_path}/j")
    assert files.read_jsonl(spark, f"{tmp_path}/j", "k int, v string").count() == 3
    sinks.write_csv(df, f"{tmp_path}/c")
    sinks.write_table(df, f"{tmp_path}/t", "k")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert {(r.k, r.side) for r in sinks.differences(df, df.distinct()).collect()} == {(1, "+")}
    made = []
    for _ in range(2):
        sinks.resumed(spark, f"{tmp_path}/stage", lambda: made.append(1) or df)
    assert len(made) == 1
    sinks.write_vectors(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "chunk_id string, vector array<double>"), f"{tmp_path}/v")
    assert sinks.read_vectors(spark, f"{tmp_path}/v", 2).count() == 1


def test_progress_stream(spark, tmp_path):
    rows = [(1, "view", 1.0), (1, "purchase", 2.0), (1, "click", 1.0), (2, "error", 0.0)]
    made = spark.createDataFrame([(i, u, e, v, 1_700_000_000 + 60 * i) for i, (u, e, v) in enumerate(rows)], "event_id long, user_id long, event_type string, value double, s long")
    made.select("event_id", "user_id", "event_type", "value", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = progress.states(stream).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.stage, r.failed, r.n, r.kinds) for r in spark.table("states").collect()} == {(1, 3, False, 3, 3), (2, 0, True, 1, 1)}
    q = progress.windowed(stream, "2 minutes", late="1 minute").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").count() >= 1
    q = progress.first_seen(stream).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 4
    assert progress.last_entries(spark.read.parquet(f"{tmp_path}/in"), 2).count() == 2


def test_extraction_stream(spark, tmp_path):
    rows = [("f", "s1", "Width shall be 5 mm"), ("f", "s2", "nothing here")]
    spark.createDataFrame(rows, "file_id string, section_id string, line string").write.parquet(f"{tmp_path}/lines")
    stream = spark.readStream.schema("file_id string, section_id string, line string").parquet(f"{tmp_path}/lines")
    extraction.run(stream, f"{tmp_path}/events", f"{tmp_path}/state").awaitTermination()
    events = spark.read.schema("file_id string, section_id string, event string, specs string").option("recursiveFileLookup", "true").json(f"{tmp_path}/events")
    assert events.count() == 7 and events.where("event = 'complete'").count() == 1
    assert {(r.section_id, r.state) for r in extraction.section_progress(events).collect()} == {("s1", "completed"), ("s2", "completed")}
    assert "spec-" in events.where("event = 'processed' and section_id = 's1'").first().specs
