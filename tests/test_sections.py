"""Headers placed in documents, bounded and matched by likeness, against brute force over all pairs."""

import difflib
import random
import re

import pytest

from tessera.operators import headers, likeness, matching


def fold(text):
    return re.sub(r"\s+", " ", (text or "").strip()).lower()


def make(seed=3):
    rng = random.Random(seed)
    words = "scope general voltage range safety relay 1 2 12 1.1 A ab é motors service services".split()
    phrase = lambda k: " ".join(rng.choices(words, k=k))
    lines, heads = [], []
    for f in "abcdef":
        for i in range(rng.randint(0, 40)):
            lines.append((f, i, rng.choice([phrase(rng.randint(1, 6)), phrase(2).upper(), "", "  ", None, "é" * 3])))
        for p in range(1, rng.randint(2, 12)):
            heads.append((f, p, rng.choice(["1", "2", "12", "1.1", "", None]), rng.choice([phrase(rng.randint(1, 3)), "ange", "SCOPE", "", None, "x9 qq"])))
    return heads, lines


def first_fit(head, lines):
    key, number, name = fold(" ".join(x for x in head[2:] if x is not None)), fold(head[2]), fold(head[3])
    folded = [(o, fold(t)) for o, t in lines if t is not None]
    for fits in (lambda t: t.startswith(key), lambda t: number and t.startswith(number) and name in t, lambda t: name and name in t):
        if (at := next((o for o, t in folded if fits(t)), None)) is not None:
            return at
    return None


def tables(spark, heads, lines):
    return spark.createDataFrame(heads, "file_id string, position int, section_number string, section_name string"), spark.createDataFrame(lines, "file_id string, ord int, line string")


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_located_and_bounded(spark, monkeypatch, block):
    """Whole documents and documents in blocks; ties of starts, missing starts, null numbers."""
    monkeypatch.setattr(headers, "BLOCK", block)
    heads, lines = make()
    found = headers.located(*tables(spark, heads, lines)).cache()
    of = {f: [(o, t) for g, o, t in lines if g == f] for f in "abcdef"}
    starts = {h[:2]: first_fit(h, of[h[0]]) for h in heads}
    assert {(r["file_id"], r["position"]): r["start"] for r in found.collect()} == starts
    sizes = {f: max((o for o, _ in of[f]), default=-1) + 1 for f in of}

    def later(h):
        own = starts[h[:2]]
        return min((s for (f, p), s in starts.items() if own is not None and f == h[0] and p > h[1] and s is not None and s > own), default=sizes[h[0]])

    def other(h):
        own = starts[h[:2]]
        return min((starts[x[:2]] for x in heads if own is not None and None not in (x[2], h[2], starts[x[:2]]) and x[0] == h[0] and x[2] != h[2] and starts[x[:2]] > own), default=sizes[h[0]])

    for bound, expected in ((headers.bounded, later), (matching.closed_by_others, other)):
        assert {(r["file_id"], r["position"]): r["stop"] for r in bound(found).collect()} == {h[:2]: expected(h) for h in heads}
    texts = {(r["file_id"], r["position"]): r["section_text"] for r in headers.section_texts(headers.bounded(found), tables(spark, heads, lines)[1]).collect()}
    for h in heads:
        body = [t for o, t in of[h[0]] if starts[h[:2]] is not None and starts[h[:2]] <= o < later(h)]
        assert texts.get(h[:2]) == ("\n".join(t for t in body if t is not None) if body else None)


def best(name, lines):
    """The highest ratio, then the greatest line, then its first place."""
    matcher = difflib.SequenceMatcher(None, "", name or "")
    ranked = []
    for o, t in lines:
        if t is not None:
            matcher.set_seq1(t)
            ranked.append((matcher.ratio(), t, -o))
    return max(ranked, default=None)


def test_closest(spark):
    heads, lines = make(8)
    lines += [("a", 90 + i, t) for i, t in enumerate(["relay" * 50, "e" * 230, "\U0001f600 relay", "Re1ay safcty"])]
    heads += [("a", 50 + i, None, t) for i, t in enumerate(["relay " * 40, "e" * 210, "\U0001f600", "rclay safety", "zzz", "é"])]
    of = {f: [(o, t) for g, o, t in lines if g == f] for f in "abcdef"}
    h, b = tables(spark, heads, lines)
    found = likeness.closest(h.withColumnRenamed("section_name", "name"), b).collect()
    expected = {x[:2]: best(x[3], of[x[0]]) for x in heads}
    assert {(r["file_id"], r["position"]): (r["ratio"], r["line"], -r["ord"]) for r in found} == {k: v for k, v in expected.items() if v}
    placed = headers.located_by_likeness(headers.located(h, b), b)
    for r in placed.collect():
        fit = first_fit((None, None, r["section_number"], r["section_name"]), of[r["file_id"]])
        assert r["start"] == (fit if fit is not None else -best(r["section_name"], of[r["file_id"]])[2] if of[r["file_id"]] else None)


def test_no_pairs(spark):
    """No header meets all lines of its file: joins are by words and characters, and starts are swept."""
    h, b = tables(spark, *make())
    plan = headers.bounded(headers.located(h, b))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
