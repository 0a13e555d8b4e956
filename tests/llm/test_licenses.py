"""The index decides: its frequencies move the scores, clashing columns do no harm."""

from tessera.llm import licenses

NOTICE = "Licensed under the Apache License, Version 2.0 (the License)"


def test_frequencies_and_clashes(spark):
    rows = [(0, f"x {NOTICE} y"), (1, "GNU General Public License version 2"), (2, "the " * 50), (3, None), (4, ""), (5, "mozilla public license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS labels", "3 AS _found", "4 AS hits")
    counted = licenses.document_frequencies(docs)
    assert counted[""] == 6 and counted["license"] == 3 and counted["the"] == 2
    found = {r.doc_id: r for r in licenses.scan(docs, counted).collect()}
    plain = {r.doc_id: r for r in licenses.scan(docs, {"": 6} | {w: 1 for w in counted if w}).collect()}
    assert found[0].labels == "apache,apache-2.0" and found[1].labels == "gpl,gpl-2.0" and found[5].labels == "mpl-2.0"
    assert 0 < found[5].score < 0.5 and found[1].score >= 0.5 and found[5].score != plain[5].score
    assert all(found[k].labels == "" and found[k].score == 0 and found[k].n_words == n for k, n in ((2, 50), (3, 0), (4, 0)))
    assert found[0]._found == 3 and found[0].hits == 4
    weights = licenses.idf(counted)
    t = next(t for t in licenses.NOTICES if t.label == "apache-2.0")
    here = NOTICE.lower().replace(",", "").replace(".", " ").replace("(", "").replace(")", "").split()
    share = sum(weights[x] for a, x in zip(here, t.words(), strict=False) if a == x) / sum(weights[x] for x in t.words())
    assert abs(found[0].score - max(0.5, round(share, licenses.DIGITS))) < 1e-9
