"""Lines of nested pages read from JSON."""

import json

import pytest

from tessera.operators import page_lines


def span(text, font="Serif", size=10.0, flags=0):
    return {"text": text, "font": font, "size": size, "flags": flags}


def line(x, y, *spans, box=True):
    return {"bbox": [x, y, x + 100.0, y + 10.0] if box else None, "spans": list(spans)}


@pytest.fixture
def pages(spark, tmp_path):
    one = [
        {"type": 0, "lines": [line(320.0, 50.0, span("Right one")), line(320.0, 70.0, span("RIGHT TWO", flags=2)), line(320.0, 90.0, span("r3")), line(320.0, 20.0)]},
        {"type": 2, "lines": [line(10.0, 10.0, span("drawing"))]},
        {"type": 1, "lines": [line(40.0, 60.0, span(" Left ", None, 12.0), span("two ", "Sans-Bold", 0.0, 4), span(None, "", 9.0)), line(40.0, 50.0, span("Left one")), line(40.0, 80.0, span("   "))]},
        {"type": 0},
        {"type": 0, "lines": [line(40.0, 60.0, span("É Ω 3")), line(0.0, 0.0, span("no box"), box=False)]},
    ]
    rows = [{"file_id": "f", "page_no": 1, "width": 612.0, "height": 792.0, "blocks": one}, {"file_id": "f", "page_no": 0, "width": 1.0, "height": 2.0, "blocks": [{"type": 0, "lines": [line(0.0, 1.0, span("cover"))]}]}]
    rows += [{"file_id": "g", "page_no": 0, "width": None, "height": None, "blocks": None}]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, rows)))
    return spark.read.schema(page_lines.PAGES).json(str(tmp_path / "pages.json"))


def test_reading_order(pages):
    found = sorted(page_lines.text_lines(pages).collect(), key=lambda r: r["line_idx"])
    assert [r["text"] for r in found] == ["cover", "no box", "Left one", "Left two", "É Ω 3", "Right one", "RIGHT TWO", "r3"]
    last = found[-1]["column_index"]
    assert last > 0 and [r["column_index"] == last for r in found] == [False] * 5 + [True] * 3
    two = found[3]
    assert (two["font_family"], two["font_size"], two["is_bold"], two["span_fonts"], two["flags"]) == ("Sans-Bold", 10.5, True, ["Sans-Bold"], 4)
    assert [r["is_caps"] for r in found] == [False, False, False, False, True, False, True, False]
    assert [r["is_bold"] for r in found if r["text"].startswith("R")] == [False, True]
    assert found[1]["bbox"] == [0.0] * 4 and (found[0]["page_width"], found[0]["page_height"]) == (1.0, 2.0)
    single = sorted(page_lines.text_lines(pages, multi_column=False).collect(), key=lambda r: r["line_idx"])
    assert [r["text"] for r in single][1:4] == ["no box", "Left one", "Right one"] and {r["column_index"] for r in single} == {0}
