"""The pipeline's stages, each against a brute-force version of its decision."""

import re
from collections import Counter

import corpus_pipeline
from tessera.llm import queries

from .test_near import brute_sets, similarity
from .test_queries import brute_secrets, sha, words


def stage(spark, docs, sf_dir, k, place):
    out = f"{place}/{k}"
    corpus_pipeline.STAGES[k][1](spark, docs, sf_dir).write.parquet(out)
    return spark.read.parquet(out)


def first_of_groups(docs):
    """The smallest doc_id of each group of texts that a chain of similarities of 0.8 or more links, by all pairs."""
    sets = {}
    for doc_id, text in docs:
        sets.setdefault(frozenset(brute_sets(text)), []).append(doc_id)
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    distinct = list(sets)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if similarity(a, b) >= 0.8:
                parent[root(a)] = root(b)
    groups = {}
    for s, ids in sets.items():
        groups.setdefault(root(s), []).extend(ids)
    return [min(ids) for ids in groups.values()]


def test_stages(spark, sf_dir, tmp_path, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["source"] or "")

    kept = stage(spark, docs, sf_dir, 0, tmp_path)
    verdict = Counter((r.doc_id, r.kept) for r in queries.QUERIES["op10_quality_rules"](spark, sf_dir).collect())
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: n for (d, ok), n in verdict.items() if ok})

    alone = stage(spark, kept, sf_dir, 1, tmp_path)
    before = kept.collect()
    assert sorted(r.doc_id for r in alone.collect()) == sorted(first_of_groups([(r.doc_id, r.text) for r in before]))

    clean = stage(spark, alone, sf_dir, 2, tmp_path)
    for old, new in zip(sorted(alone.collect(), key=key), sorted(clean.collect(), key=key), strict=True):
        spans = brute_secrets(old.text)
        assert (old.text == new.text) == (not spans) and new.n_chars == (len(new.text) if spans else old.n_chars)
        assert not [s for s in brute_secrets(new.text) if s[1] > 0]

    mixed = stage(spark, clean, sf_dir, 3, tmp_path)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) == 2 and set(copies) <= {r.doc_id for r in clean.collect()}
    size = sum(len(words(r.text)) for r in clean.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * size) < 0.15 * size
    assert all(x.columns == columns for x in (kept, alone, clean, mixed))

    coded = stage(spark, mixed, sf_dir, 4, tmp_path)
    assert Counter((r.doc_id, r.decoded_sha256) for r in coded.collect()) == Counter((r.doc_id, sha(r.text)) for r in mixed.collect())
    whole = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, r.ids_sha256) for r in whole.collect()) == Counter((r.doc_id, r.ids_sha256) for r in coded.collect())


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def test_clashing_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ("row", "size", "copies", "place", "m", "kept", "fp", "target", "finish", "pass", "word", "ids")
    more = docs.selectExpr("*", *(f"doc_id as `{n}`" for n in names))
    more.write.parquet(f"{tmp_path}/docs")
    more = spark.read.parquet(f"{tmp_path}/docs")
    for k in range(4):
        more = stage(spark, more, sf_dir, k, tmp_path)
        assert more.columns == [*docs.columns, *names] and re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[k][0])
    assert stage(spark, more, sf_dir, 4, tmp_path).count() == more.count() > 0
