"""op7's filter holds all its entries at any size, and its scores are probabilities."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_model as lm


def test_no_level_is_dropped(spark):
    rng = random.Random(2)
    rows = [(kind, rng.getrandbits(63), i % 97, 1 + i % 5) for kind in (lm.OF_WORD, lm.OF_PAIR) for i in range(30_000)]
    probes = 9
    bits = sum(3 * ((lm.WORD_PROBES if r[0] == lm.OF_WORD else probes) + lm.LEVEL_PROBES * (r[3] - 1)) for r in rows)
    segments = lm.segments_for(bits)
    dealt = [(int(x), *r) for x, r in zip(lm.segment_of(np.array([r[1] for r in rows], dtype=np.uint64), segments), rows, strict=True)]
    table, _ = lm.build(spark.createDataFrame(dealt, lm.ENTRY).repartition(3), segments, probes)
    own = lm.Filter(np.frombuffer(lm.whole_filter(table, segments), dtype=np.uint64), segments)
    said = Counter()
    for kind, first in ((lm.OF_WORD, lm.WORD_PROBES), (lm.OF_PAIR, probes)):
        mine = [r for r in rows if r[0] == kind]
        keys, level = (np.array([r[k] for r in mine]) for k in (1, 3))
        found = own.levels(keys.view(np.uint64), first)
        assert (found >= level).all() and (found == level).mean() > 0.85
        for r, q in zip(mine, lm.value(found + (kind == lm.OF_PAIR)).tolist(), strict=True):
            said[-1 if kind == lm.OF_WORD else r[2]] += q
    assert {r["id"]: r["q"] for r in table.where("id is not null").groupBy("id").sum("q").toDF("id", "q").collect()} == said
    others = np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert (own.levels(others, lm.WORD_PROBES) == 0).mean() > 0.99 and (own.levels(others, probes) == 0).all()


def model(spark, texts):
    return lm.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))


TEXTS = ["the cat sat on the mat", "the cat sat on the hat the end", "a dog and the cat sat", "the dog sat on a mat", None, "", "x" * 90 + " the cat " + "x" * 90 + " the"] * 3


@pytest.mark.parametrize("context", [b"the", b"cat", b"on", b"", b"x" * 90, b"never"])
def test_probabilities_sum_to_one(spark, context):
    m = model(spark, TEXTS)
    lookup = lm.Lookup(*(lm.Filter(np.frombuffer(lm.whole_filter(*x), dtype=np.uint64), x[1]) for x in (m.counts, m.contexts)), m.numbers.pair_probes)
    vocabulary = sorted({lm.name(w) for t in TEXTS for w in tokens(t)})
    context = lm.name(context)
    words = [*vocabulary, b"unseen", context]
    ids = np.array([lm.word_id(w) for w in words], dtype=np.uint64)
    n = len(vocabulary)
    at = np.array([x for k in range(n + 1) for x in (n + 1, k)])
    total = (10 ** lm.log10_probabilities(ids, at, lookup, m.numbers)[1::2]).sum()
    assert abs(total - 1) < 1e-6


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def brute(texts, held):
    """The formula by plain counts, quantised."""
    quantised = lambda n: math.floor(1.375 * 2 ** (n.bit_length() - 1))
    one, two = Counter(), Counter()
    for t in texts:
        w = tokens(t)
        one.update(w)
        two.update(zip([lm.END, *w], w, strict=False))
    pairs = {k: quantised(n) for k, n in two.items() if n > 1}
    sums = Counter()
    for (c, _), q in pairs.items():
        sums[c] += q
    said = {w: quantised(n) for w, n in one.items()}
    whole = sum(said.values()) + 0.1 * (len(said) + 1)
    out = []
    for t in held:
        w, score = tokens(t), 0.0
        for c, x in zip([lm.END, *w], w, strict=False):
            free = lm.BETA + max(said.get(c, 0) - sums[c], 0)
            score += math.log10((pairs.get((c, x), 0) + free * (said.get(x, 0) + 0.1) / whole) / (sums[c] + free))
        out.append(score)
    return out


@pytest.mark.parametrize("bound", [lm.BROADCAST_BYTES, 0])
def test_scores(spark, monkeypatch, bound):
    """Against the formula, with the filter broadcast and as a table."""
    monkeypatch.setattr(lm, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(lm, "LEVEL_PROBES", 8)  # levels without false hits
    monkeypatch.setattr(lm, "SPARE", 20)
    monkeypatch.setattr(lm, "BLOCK", 4)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 6000, 60)] + TEXTS
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    train = [t for i, t in enumerate(texts) if i % 2]
    m = model(spark, train)
    found = {r.doc_id: r.score for r in lm.score(docs, m).collect()}
    expected = brute(train, texts)
    assert len(found) == len(texts) and all(math.isclose(found[i], x, rel_tol=1e-9) for i, x in enumerate(expected))


def test_keys_travel_packed(spark, monkeypatch):
    """A filter that stays a table gives the scores of one that is broadcast; a block's keys for a part of it are one row, not a row each."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(200)) for _ in range(1_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts, None, ""])], "doc_id long, text string").repartition(3)
    m = lm.train(docs.select("text"))
    expected = sorted(map(tuple, lm.score(docs, m).collect()))
    for name, value in (("BROADCAST_BYTES", 0), ("BLOCK", 150), ("ASKED", 1)):
        monkeypatch.setattr(lm, name, value)
    assert m.counts[1] > 3
    exchanged, whole = [], lm.materialize

    def watched(df):
        out = whole(df)
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanged.append(("HashAggregate" in plan, plan.count("FlatMapCoGroupsInArrow")))
        return out

    monkeypatch.setattr(lm, "materialize", watched)
    found = sorted(map(tuple, lm.score(docs, m).collect()))
    assert [x[:5] for x in found] == [x[:5] for x in expected]
    assert all(math.isclose(a, b, rel_tol=1e-9) for x, y in zip(found, expected, strict=True) for a, b in zip(x[5:], y[5:], strict=True))
    assert len(exchanged) == lm.ROUNDS and not any(aggregated for aggregated, n in exchanged if n)


def test_ids_are_made_at_once(monkeypatch):
    """Short names' ids are XXH64's, made without a call for each name."""
    rng = random.Random(6)
    names = [b"", *(rng.randbytes(n) for n in range(66) for _ in range(5))]
    expected, one = [lm.word_id(x) for x in names], lm.word_id
    called = []
    monkeypatch.setattr(lm, "word_id", lambda x: called.append(x) or one(x))
    whole = pa.array([b"before", *names, b"after"], pa.binary())
    assert lm.word_ids(whole.slice(1, len(names))).tolist() == expected
    assert called and all(len(x) >= 32 for x in called)
    assert len(lm.word_ids(pa.array([], pa.binary()))) == 0 and lm.word_ids(pa.array([b""], pa.binary())).tolist() == expected[:1]


def test_frequent_words_are_asked_once(spark, monkeypatch):
    """A reader asks the filter about a frequent word once, about others each time; scores are those of a reader that knows none."""
    m = model(spark, TEXTS)
    lookup = lm.Lookup(*(lm.Filter(np.frombuffer(lm.whole_filter(*x), dtype=np.uint64), x[1]) for x in (m.counts, m.contexts)), m.numbers.pair_probes)
    asked, words = [], lm.Lookup.words
    monkeypatch.setattr(lm.Lookup, "words", lambda self, ids: asked.append(len(ids)) or words(self, ids))
    texts = lm.coded(pa.array([*TEXTS, "never seen"], pa.string()))
    head = lm.Head(lm.Head.packed(m.vocabulary))
    first, again = (head.scored(texts, lookup, m.numbers) for _ in range(2))
    monkeypatch.setattr(lm, "HEAD_WORDS", 0)
    empty = lm.Head(lm.Head.packed(m.vocabulary))
    whole = empty.scored(texts, lookup, m.numbers)
    assert asked == [len(texts.ids), 2, len(texts.ids)] and len(texts.ids) == len(head.ids) + 2
    assert first[3].equals(again[3]) and first[3].equals(whole[3])


def test_questions_are_found_by_sorting(spark, monkeypatch):
    """Without ``np.unique``, whose hash table took most of a block's time; and no digit is asked for that no context's sum has."""
    m = model(spark, TEXTS)
    sums = [r["q"] for r in m.counts[0].where("id <> -1").groupBy("id").sum("q").toDF("id", "q").collect()]
    assert m.numbers.digits == max(sums).bit_length() < lm.LEVELS
    rng = random.Random(7)
    texts = pa.array([*TEXTS, *(" ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(50)) for _ in range(40))], pa.string())
    tokens = lm.coded(texts)
    ids, at = tokens.ids, tokens.at
    before = np.concatenate([[len(ids) - 1], at[:-1]])
    expected = {lm.OF_WORD: lm.key_of(lm.OF_WORD, ids), lm.OF_CONTEXT: lm.key_of(lm.OF_CONTEXT, ids), lm.OF_PAIR: lm.pair_key(ids[before], ids[at])}
    expected = {kind: sorted(set(keys.tolist())) for kind, keys in expected.items()}
    monkeypatch.delattr(np, "unique")
    found = lm.Parts({kind: 9 for kind in expected}, 2).questions(tokens)
    for kind, (part, keys) in found.items():
        assert sorted(keys.tolist()) == expected[kind]
        rows = list(zip(part.tolist(), keys.tolist(), strict=True))
        assert rows == sorted(rows) and len(set(part.tolist())) > 1
    assert len(lm.distinct(np.zeros(0, dtype=np.uint64))) == 0
