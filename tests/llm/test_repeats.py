"""Long repeats against brute force over whole tables, and the index against a plain search."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessera.llm import queries, repeats



def brute(docs, length=100):
    """(spans, kept) of each of ``docs`` ((doc_id, text)), by a dictionary of all strings of ``length`` bytes."""

    def tie(text):
        x = xxhash.xxh64_intdigest((text or "").encode(), 42)
        return x - (1 << 64) if x >> 63 else x

    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, tie(docs[i][1]) if docs[i][1] is not None else 42, i))
    seen, out = set(), {}
    for i in order:
        raw = (docs[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            b = gone.find(0, a)
            at = len(raw) if b < 0 else b
            spans.append((a, at))
        out[i] = spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g)
    return [out[i] for i in range(len(docs))]


def digest(docs):
    return sorted(
        (repr(d[0]), len((d[1] or "").encode()), len((d[1] or "").encode()) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        for d, (spans, kept) in zip(docs, brute(docs), strict=True)
    )


def found(spark, place):
    return sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op11_remove_repeats(spark, place).collect())


def test_query(spark, sf_dir, rows):
    assert found(spark, sf_dir) == digest([(r[0], r[1]) for r in rows])


def awkward():
    rng = random.Random(5)
    prose = lambda k: "".join(rng.choices("abcdefghij é", k=k))
    shared = [prose(k) for k in (99, 100, 101, 150, 400, 2000)]
    docs = []
    for i in range(120):
        parts = [prose(rng.randint(0, 150)), rng.choice(shared), prose(rng.randint(0, 90)), rng.choice(shared)[rng.randint(0, 60) :]]
        docs.append((rng.choice([i, i, 7, None]), "".join(parts)))
    docs += [(500, "x" * 5000), (501, "ab" * 700), (502, "x" * 150), (-3, prose(1500)), (503, shared[4] * 3), (503, shared[4] * 3)]
    docs += [(504, None), (505, ""), (506, shared[0]), (507, "é" * 200)]
    return docs


@pytest.mark.parametrize("hot", [repeats.SIZES.hot, 3])
def test_awkward(spark, tmp_path, hot):
    """Ties of doc_id, null ids, runs of one letter, repeats inside a text, many blocks, pieces and groups; hot anchors by single windows."""
    docs = awkward()
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, kept int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(spark, str(tmp_path)) == digest(docs)
    small = repeats.Sizes(group=9000, piece=900, block=3000, hot=hot)
    rows = repeats.without_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet"), sizes=small).collect()
    assert sorted((repr(r["row"]["doc_id"]), [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows) == sorted((repr(d[0]), *x) for d, x in zip(docs, brute(docs), strict=True))
    assert {r["row"]["kept"] for r in rows} == {1}


def test_index():
    """Φ, shared lengths and first starts against plain sorting; copies add few runs."""
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 101, 300).astype(np.uint8))
    texts = list(dict.fromkeys([base[a : a + k] for a, k in zip(rng.integers(0, 200, 60), rng.integers(5, 90, 60), strict=True)]))
    index = repeats.RunIndex(texts)
    whole = index.text.tolist()
    order = sorted(range(len(whole)), key=lambda i: whole[i:])
    phi, shared = index.statistics()
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while whole[a + k : a + k + 1] == whole[b + k : b + k + 1] != []:
            k += 1
        assert (phi[b], shared[b]) == (a, k)
    assert phi[order[0]] == -1
    flags = index.repeated(12)
    for p in range(len(whole)):
        window = whole[p : p + 12]
        real = len(window) == 12 and min(window) >= len(texts)
        assert bool(flags[p]) == (real and any(whole[q : q + 12] == window for q in range(p)))
    assert len(index.begins) < len(whole) / 2
