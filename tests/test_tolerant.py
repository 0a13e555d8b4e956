"""Good and malformed files in one folder: problem rows instead of a failed job."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, tolerant


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/utf.txt").write_bytes("﻿café\nzwei".encode())
    (tmp_path / "in/win.txt").write_bytes("price 5 € – naïve “quoted”".encode("cp1252"))
    (tmp_path / "in/bin.txt").write_bytes(b"ab\x00\x01\xff")
    (tmp_path / "in/empty.txt").write_bytes(b"")
    (tmp_path / "in/broken.docx").write_bytes(b"PK\x03\x04 no archive")
    with zipfile.ZipFile(tmp_path / "in/other.docx", "w") as z:
        z.writestr("else.xml", "<a/>")
    with zipfile.ZipFile(tmp_path / "in/torn.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document")
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "in/good.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body><w:p><w:r><w:t>Fine</w:t></w:r></w:p></w:body></w:document>")
    return tmp_path


def test_files(spark, folder):
    found = files.binary(spark, str(folder / "in"))
    names = {r.file_id: r.path.rsplit("/", 1)[1] for r in found.collect()}
    txt = files.text_objects(found.where("extension = 'txt'")).collect()
    assert sorted((names[r.file_id], r.line_index, r.text, r.metadata["encoding"]) for r in txt) == [
        ("utf.txt", 0, "café", "utf-8"), ("utf.txt", 1, "zwei", "utf-8"), ("win.txt", 0, "price 5 € – naïve “quoted”", "windows-1252"),
    ]
    docx = found.where("extension = 'docx'")
    assert [r.text for r in files.docx_objects(docx).collect()] == ["Fine"]
    told = {names[r.file_id]: r.problem.split(":")[0] for r in files.docx_problems(docx).collect()}
    assert told == {"broken.docx": "BadZipFile", "other.docx": "KeyError", "torn.docx": "ParseError"}


def test_every_windows_byte(spark):
    """Each byte as Python's codec has it; those it leaves out stay control characters."""
    codes = [b for b in range(1, 256)]
    rows = spark.createDataFrame([(b, bytearray(bytes([0x41, b, 0x41]))) for b in codes], "b int, content binary")
    found = {r.b: r.t for r in rows.select("b", tolerant.decoded(F.col("content"))["text"].alias("t")).collect()}
    for b in codes:
        raw = bytes([0x41, b, 0x41])
        assert found[b] == (raw.decode() if b < 128 else raw.decode("cp1252", "ignore") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else f"A{chr(b)}A")


def obj(**x):
    return {"object_id": "o1", "file_id": "f", "kind": "para", "text": "t", **x}


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "arrays").mkdir()
    lines = [obj(), obj(object_id="o2", page_index="3", bbox=[1, 2.5, 3, 4], metadata={"a": "b", "n": 1}), {"kind": "para"}, [1], "text", obj(file_id=None), obj(object_id="o3", file_id="h", page_index="x", order_index=2.0)]
    (tmp_path / "lines/a.jsonl").write_text("\n".join([*map(json.dumps, lines), "", '{"object_id": "torn', "   "]))
    (tmp_path / "lines/empty.jsonl").write_text("")
    (tmp_path / "arrays/g.json").write_text(json.dumps([obj(object_id="g1", file_id="g"), 5, obj(object_id="again", file_id="f")]))
    (tmp_path / "arrays/bad.json").write_text('{"object_id": "x", "file_id": "y", "kind": "z"}')
    (tmp_path / "arrays/torn.json").write_text('[{"object_id": ')
    return tmp_path


def test_json(spark, sources):
    first = tolerant.read_object_lines(spark, str(sources / "lines"))
    rows = {r.object_id: r for r in tolerant.good(first).collect()}
    assert set(rows) == {"o1", "o2", "o3"}
    assert (rows["o2"].page_index, rows["o2"].bbox, rows["o2"].metadata) == (3, [1.0, 2.5, 3.0, 4.0], {"a": "b", "n": "1"})
    assert (rows["o3"].page_index, rows["o3"].order_index, rows["o1"].page_index) == (None, 2, None)
    assert sorted(r.problem for r in tolerant.problems(first).collect()) == ["malformed", "missing file_id", "missing object_id", "not an object", "not an object"]
    second = tolerant.read_object_arrays(spark, str(sources / "arrays"))
    assert sorted(r.problem for r in tolerant.problems(second).collect()) == ["malformed", "not an array", "not an object"]
    both = tolerant.first_source(first, second)
    assert sorted((r.file_id, r.object_id) for r in both.collect()) == [("f", "o1"), ("f", "o2"), ("g", "g1"), ("h", "o3")]


def test_sidecars(spark, tmp_path):
    for name in ("f/b.csv", "f/a.xlsx", "f/a.csv", "f/notes.md", "g/t.CSV"):
        (tmp_path / "out" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "out" / name).write_text("x,y\n1,2\n")
    found = tolerant.sidecars(spark, str(tmp_path / "out"))
    assert [(r.file_id, r.place, r.stem) for r in found.orderBy("file_id", "place").collect()] == [("f", 1, "a"), ("f", 2, "b"), ("f", 3, "a"), ("g", 1, "t")]
    objects = spark.createDataFrame([("o", "f", "para", "t", 4)], "object_id string, file_id string, kind string, text string, order_index int")
    rows = tolerant.with_sidecars(objects, found).orderBy("file_id", "order_index").collect()
    assert [(r.file_id, r.object_id, r.kind, r.order_index) for r in rows] == [("f", "o", "para", 4), ("f", "table-a", "table", 5), ("f", "table-b", "table", 6), ("f", "table-a", "table", 7), ("g", "table-t", "table", 0)]
    assert rows[3].metadata["table_file"].endswith("f/a.xlsx")


def test_reasoning(spark):
    cases = {
        '"plain"': "plain",
        '{"content": "a", "text": ["b", null, 3], "message": {"x": 1}}': "a\nb\n3",
        '["one", {"text": "two"}, {"content": "three", "text": ""}, {"other": 1}, 5]': "one\ntwo\nthree",
        "null": "", "not json": "", "12": "12",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    found = {r.p: r.t for r in rows.select("p", tolerant.reasoning_text(F.col("p")).alias("t")).collect()}
    assert found == cases | {None: ""}


def test_checked_makes_no_schema_of_a_record(spark):
    rows = [' \t\n{"object_id": "a", "file_id": "f", "kind": "line", "page_index": "3"}', "[1]", '"{"', '{"object_id": 7, "file_id": "f"}', "{", "7", "null", None, "\u00a0{}", " {}"]
    made = tolerant.checked(spark.createDataFrame([(x,) for x in rows], "json string"))
    assert "schema_of_variant" not in made._jdf.queryExecution().optimizedPlan().toString().lower() and made.columns[-2:] == ["metadata", "problem"]
    found = [(r.object_id, r.page_index, r.problem) for r in made.collect()]
    assert found[:4] == [("a", 3, None), (None, None, "not an object"), (None, None, "not an object"), ("7", None, "missing kind")]
    assert [x[2] for x in found[4:]] == ["malformed", "not an object", "not an object", "malformed", "malformed", "missing object_id"]
