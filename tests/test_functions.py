"""Column functions and operators on hand-made rows."""

import difflib
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity, specs, text
from tessera.operators import adapters, atomize, headers, layout, lines, quality, search, toc
from tessera.plans import sequences


def values(spark, column, *inputs):
    return [r[1] for r in sorted(spark.createDataFrame(list(enumerate(inputs)), "i int, x string").select("i", column(F.col("x"))).collect())]


def test_atomizer(spark):
    rows = ["- Enclosure shall be rated IP65", "Spacing shall be 2 cm", "Panel must operate at 24 VDC ±10%", "Software version should be 1.2.0", "Surface must not exceed 140 °F", "General marketing copy"]
    made = atomize.atomize(spark.createDataFrame([("f", "s", r) for r in rows], "file_id string, section_id string, line string")).collect()
    by = {r.spec_text: r for r in made}
    assert len(made) == 5 and len({r.spec_id for r in made}) == 5 and all(r.spec_id.startswith("spec-") for r in made)
    r = by["Spacing shall be 2 cm"]
    assert (r.raw_value, r.normalized_value, r.normalized_unit, r.category, r.confidence) == ("2 cm", 20.0, "mm", "mechanical", 1.0)
    r = by["Panel must operate at 24 VDC ±10%"]
    assert (r.normalized_value, r.normalized_unit, r.category) == (24.0, "VDC", "electrical")
    r = by["Software version should be 1.2.0"]
    assert (r.category, r.confidence) == ("software", 0.8)
    r = by["Surface must not exceed 140 °F"]
    assert (r.normalized_value, r.normalized_unit, r.category) == (60.0, "degC", "mechanical")
    assert by["Spacing shall be 2 cm"].spec_id == "spec-" + hashlib.sha1(b"f:s:Spacing shall be 2 cm").hexdigest()[:12]


def test_units_as_first_alternative(spark):
    found = values(spark, lambda x: specs.measured(x)["normalized_value"], "5 mA", "3 months", "5-10 mm", "2.5 kV", "none")
    assert found == [5000.0, 3000.0, -10.0, 2500.0, None]


def test_identity(spark):
    assert values(spark, identity.uuid5, "0:3:Scope", "é") == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("0:3:Scope", "é")]


def test_numbers(spark):
    inputs = ("1.2 Scope", "IV. Results", "A.1 Annex", "mix design", "plain words", "3) Item")
    assert values(spark, lambda x: text.split_number(x)["number"], *inputs) == ["1.2", "IV", "A.1", "mix", None, "3"]
    assert values(spark, text.segment_count, "1", "1.2", "A", "A.1", "1.2.3", "") == [1, 2, 2, 3, 3, 0]


def test_toc_lines(spark):
    inputs = ("5.2 Transformer connections ......... 4", "Preface ... iv", "1 Scope", "Overview · · · 12", "Annex A … 32")
    assert values(spark, text.is_toc_entry, *inputs) == [True, True, False, True, True]
    assert values(spark, text.is_toc_line, "Goals ___ 12", "Overview of goals", "Part mix") == [True, False, True]


def test_toc_pages(spark):
    rows = [("f", 0, "Table of Contents"), ("f", 0, "1 A .... 2"), ("f", 1, "2 B .... 3"), ("f", 1, "3 C ..... 4"), ("f", 2, "1 A"), ("f", 3, "x .... 1"), ("f", 3, "y ... 2")]
    rows += [("f", 5, f"t{i} .... {i}") for i in range(3)] + [("f", 6, f"t{i} .... {i}") for i in range(2)]
    df = spark.createDataFrame(rows, "file_id string, page int, line string")
    assert sorted(r.page for r in toc.toc_pages(df).collect()) == [0, 1, 5, 6]
    assert {r.line for r in toc.real_header_lines(df).collect()} == {"1 A"}


def test_cleaning(spark):
    assert values(spark, text.fix_ocr, "trans-\nformer  x", "Trans-\nFormer") == ["trans-former x", "Trans-Former"]
    assert values(spark, text.fold_spaces, "  A B \t C ", "") == ["a b c", ""]
    assert values(spark, text.clean_spec_line, "- 1.2) Do", "24.5 VDC", "•* x") == ["Do", "5 VDC", "x"]  # an enumerator may eat a decimal
    assert values(spark, text.normalize_spec_line, "- Bolt M8.;", "2. Nut", "3.1 Washer:") == ["Bolt M8", "Nut", "Washer"]
    assert values(spark, lambda x: F.array_join(text.lines(x), "|"), "a\nb\r\nc\n", "", "a\n\nb") == ["a|b|c", "", "a||b"]
    assert values(spark, text.natural_key, "a2", "a10", "A1")[0] < values(spark, text.natural_key, "a2", "a10", "A1")[1]


def test_natural_order(spark):
    """Numbers of any length, leading zeros, none at all."""
    texts = ["a" + "9" * 30, "a1" + "0" * 30, "a007", "a7", "a10", "a", "a0", "B2", "b10"]
    keys = dict(zip(texts, values(spark, text.natural_key, *texts), strict=True))
    assert sorted(texts, key=lambda x: (keys[x], x)) == ["a", "a0", "a007", "a7", "a10", "a" + "9" * 30, "a1" + "0" * 30, "B2", "b10"]


def test_sections(spark):
    rows = [("f", 0, "1 Intro"), ("f", 1, "text a"), ("f", 2, "1.1 Scope"), ("f", 3, "text b"), ("f", 4, "1.2 Goals"), ("f", 5, "2 Methods"), ("f", 6, "text c")]
    body = spark.createDataFrame(rows, "file_id string, ord int, line string")
    heads = headers.rule_headers(body)
    tree = {r.position: r for r in headers.section_tree(headers.leveled(heads)).collect()}
    assert [(tree[k].section_number, tree[k].parent, tree[k].last, tree[k].path) for k in sorted(tree)] == [
        ("1", None, 3, "1 Intro"), ("1.1", 1, 2, "1 Intro / 1.1 Scope"), ("1.2", 1, 3, "1 Intro / 1.2 Goals"), ("2", None, 4, "2 Methods"),
    ]
    chunks = {r.position: r.objects for r in headers.section_chunks(headers.section_tree(headers.leveled(heads)), body).collect()}
    assert chunks == {1: "3", 2: "3", 4: "6"}
    bounds = headers.bounded(headers.located(heads, body), body.groupBy("file_id").agg((F.max("ord") + 1).alias("n")))
    assert [(r.start, r.stop) for r in sorted(bounds.collect(), key=lambda r: r.position)] == [(0, 2), (2, 4), (4, 5), (5, 7)]
    texts = {r.position: r.section_text for r in headers.section_texts(bounds, body).collect()}
    assert texts[2] == "1.1 Scope\ntext b"
    block = headers.header_block(heads)
    assert [(r.section_number, r.section_name) for r in sorted(headers.parse_header_block(block).collect(), key=lambda r: r.at)] == [("1", "Intro"), ("1.1", "Scope"), ("1.2", "Goals"), ("2", "Methods")]
    anchors = {r.position: r.anchor for r in sequences.anchored(heads, body.withColumn("line", F.regexp_replace("line", r"^[\d.]+ ", ""))).collect()}
    assert anchors == {1: 0, 2: 2, 3: 4, 4: 5}


def test_nested_list():
    assert sequences.depths(["1. Introduction", "  1.1 Background", "      deep", "2. Methods"]) == [(0, "1.", "Introduction"), (1, "1.1", "Background"), (2, "", "deep"), (0, "2.", "Methods")]


def test_closest(spark):
    rows = [("f", i, x) for i, x in enumerate(["alpha beta", "gamma delta", "gamma"])]
    body = spark.createDataFrame(rows, "file_id string, ord int, line string")
    heads = spark.createDataFrame([("f", 1, "gama delta")], "file_id string, position int, section_name string")
    r = sequences.closest(heads, body).first()
    assert r.ord == 1 and r.ratio == pytest.approx(difflib.SequenceMatcher(None, "gamma delta", "gama delta").ratio(), abs=1e-6)


def test_search(spark):
    docs = spark.createDataFrame([(1, "24 VDC safety relay required"), (2, "enclosure width 20 mm"), (3, "software checklist for commissioning")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "24 VDC safety relay"), (1, "software checklist")], "query_id long, text string")
    best = {r.query_id: r for r in search.hybrid(docs, asked, 1).collect()}
    assert best[0].doc_id == 1 and best[1].doc_id == 3 and best[0].bm25 > 0
    v = docs.select(search.embedding(F.col("text")).alias("v")).first().v
    digest = hashlib.sha256(b"24 VDC safety relay required").digest()
    raw = [digest[i % 32] for i in range(384)]
    mean = sum(raw) / 384
    norm = sum((x - mean) ** 2 for x in raw) ** 0.5
    assert v == pytest.approx([(x - mean) / norm for x in raw], abs=1e-12)
    assert docs.select(adapters.embedded(F.col("text"), lambda t: [[3.0, 4.0]] * len(t))).first()[0] == [0.6, 0.8]


def test_columns():
    assert layout.column_of([50.0, 52.0, 51.0]) == [0, 0, 0]
    assert layout.column_of([450.0, 100.0, 101.0, 452.0, 99.0, 449.0]) == [1, 0, 0, 1, 0, 1]


def test_lines_and_choice(spark):
    objects = spark.createDataFrame(
        [("f", "a", "para", " x ", 1, 0, 4), ("f", "b", "table", "r1\n\nr2", 0, 1, 5), ("f", "c", "figure", None, 0, 0, None)],
        "file_id string, object_id string, kind string, text string, page_index int, order_index int, line_index int",
    )
    assert [(r.line_no, r.entry, r.line_index) for r in sorted(lines.object_lines(objects).collect(), key=lambda r: r.line_no)] == [(0, "r1", None), (1, "r2", None), (2, "x", 4)]
    assert quality.engine_choice(objects).first().engine == "layout"
    assert quality.scanned_only(objects).count() == 0
    assert [r.text for r in lines.joined(lines.document_lines(spark.createDataFrame([(1, "a\n \n b\n")], "doc_id int, text string")), "doc_id", "line_index", "line").collect()] == ["a\nb"]


def test_adapters(spark):
    answers = spark.createDataFrame([("f", "x #specs#\n- one\nNONE\n* two\n#specs#")], "file_id string, answer string")
    assert [r.spec_text for r in adapters.spec_lines(answers).collect()] == ["one", "two"]
    assert values(spark, adapters.message_text, '{"choices":[{"message":{"content":"hi"}}]}', '{"response":"yo"}') == ["hi", "yo"]
    assert values(spark, lambda x: adapters.generated(x, lambda p: p.upper()), "a", "b") == ["A", "B"]
    lined = spark.createDataFrame([("f", 0, "x" * 30), ("f", 1, "y" * 30)], "file_id string, ord int, line string")
    assert "y" not in adapters.outline_prompt(lined, 40).first().prompt.split("\n\n")[1]


def test_marker_variants():
    from tessera.operators import matching

    out = []
    for line in ("1) Scope Summary", "1 Scope Summary", "Section 1.1 Background"):
        out += [v for v in matching.variants(line) if v not in out]
    assert out == ["scope summary", "1 scope summary", "summary", "1 1 background", "section 1 1 background", "background"]


def test_verification(spark):
    from tessera.operators import matching

    doc = "Contents\nScope .... 2\n\nScope\nbody of it\nLong Title\nmore"
    assert matching.position(doc, "Scope") == (doc.index("\nScope\n") + 1, None)
    assert matching.position(doc, "Long Title")[0] is None and matching.position(doc, "Long Title", strict=False)[0] == doc.index("Long Title")
    heads = spark.createDataFrame([("f", 1, "1", "Scope"), ("f", 2, "2", "scope"), ("f", 3, "3", "Nowhere to be found"), ("f", 4, "4", "x" * 130)], "file_id string, position int, section_number string, section_name string")
    found = {r.position: r for r in matching.verified(heads, spark.createDataFrame([("f", doc)], "file_id string, text string")).collect()}
    assert [found[k].verified for k in sorted(found)] == [True, False, False, False] and "body of it" in found[1].evidence


def test_clean_documents(spark):
    from tessera.operators import matching

    toc = "iv\nContents\nA ..... 1\nB ..... 2\nC ..... 3\n1 Scope\ntext-\nual body\n" + "footer\nline %d\n" * 0
    docs = spark.createDataFrame([("f", toc), ("g", "xii")], "file_id string, text string")
    assert {r.file_id: r.text for r in matching.cleaned(docs).collect()} == {"f": "1 Scope\ntext-ual body", "g": "xii"}


def test_outline_and_ranges(spark):
    from tessera.operators import matching

    items = spark.createDataFrame([("f", 0, 0, "1", "A"), ("f", 1, 3, "1.1.1", "B"), ("f", 2, 1, "2", "C")], "file_id string, at int, depth int, number string, title string")
    assert [(r.section_id, r.depth) for r in matching.outline(items).orderBy("at").collect()] == [("f-sec-0001", 0), ("f-sec-0002", 1), ("f-sec-0003", 1)]
    leaves = spark.createDataFrame([("f", 1, "One", 0), ("f", 2, "Two", None), ("f", 3, "Three", 4)], "file_id string, position int, section_name string, start int")
    body = spark.createDataFrame([("f", i, x) for i, x in enumerate(["One", "a", "2. Two:", "b", "Three", "c"])], "file_id string, ord int, line string")
    assert [tuple(r) for r in matching.fallback_ranges(leaves, body).collect()] == [("f", 2, 2, 3)]


def test_cli(spark, tmp_path, capsys):
    from tessera import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1 Power\nSupply voltage must be 24 VDC\n2 Frame\nWidth shall be 5 cm\n")
    cli.main(["specs", str(tmp_path / "in"), "--out", str(tmp_path / "out")])
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert {(r.normalized_value, r.section_id[-4:]) for r in rows} == {(24.0, "0001"), (50.0, "0002")}
    cli.main(["search", str(tmp_path / "in"), "24 VDC supply", "--top", "1"])
    assert "24 VDC" in capsys.readouterr().out
