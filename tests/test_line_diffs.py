"""Differences of lines against the standard library's, and long files in about linear time."""

import difflib
import random
import time

from tessera.sources import line_diffs


def plain(a, b):
    return "\n".join(x.rstrip("\n") for x in difflib.unified_diff(a, b, "recorded", "now", lineterm=""))


def test_small_cases():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcdefg ") for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("xyza"))
        assert line_diffs.unified(a, b, "recorded", "now") == plain(a, b)


def applied(a, b):
    out, at = [], 0
    for tag, w, x, y, z in line_diffs.edits(a, b):
        assert w == at
        assert tag != "equal" or a[w:x] == b[y:z]
        out += a[w:x] if tag == "equal" else b[y:z]
        at = x
    return out, at


def test_long_files():
    """Edits rebuild the other side; half a million lines with few changes, and with none in common, take seconds."""
    rng = random.Random(2)
    a = [f"line {rng.randint(0, 10**9)}" for _ in range(200_000)]
    b = list(a)
    for at in rng.sample(range(len(b)), 60):
        b[at] = f"changed {at}"
    del b[1000:1010]
    b[5000:5000] = ["same"] * 3000
    began = time.perf_counter()
    assert applied(a, b) == (b, len(a))
    assert applied(a, [x + "!" for x in a])[1] == len(a)
    assert applied(["x"] * 3000, ["x"] * 2500 + ["y"] * 700) == (["x"] * 2500 + ["y"] * 700, 3000)
    assert len([e for e in line_diffs.edits(a, b) if e[0] != "equal"]) < 70
    assert time.perf_counter() - began < 60


def test_tables(spark):
    old = [("same", i, f"l{i}") for i in range(5)] + [("a", i, x) for i, x in enumerate(["one", "two", None, "four"])] + [("gone", 0, "x")]
    new = [("same", i + 3, f"l{i}") for i in range(5)] + [("a", i, x) for i, x in enumerate(["one", "2", "", "four", "five"])] + [("fresh", 0, "y")]
    before, now = (spark.createDataFrame(x, "file_id string, ord int, line string") for x in (old, new))
    found = {r.file_id: r.diff for r in line_diffs.line_diffs(now, before).collect()}
    assert found == {
        "a": plain(["one", "two", "", "four"], ["one", "2", "", "four", "five"]),
        "gone": "--- recorded\n+++ now\n@@ -1 +0,0 @@\n-x",
        "fresh": "--- recorded\n+++ now\n@@ -0,0 +1 @@\n+y",
    }
