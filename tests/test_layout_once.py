"""Layout queries read their lines once, and pages are clustered many at once."""

import numpy as np

from tessera.operators import corpus, layout
from tessera.plans import catalog

SOURCE = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_corpus_is_its_sql(spark):
    made = corpus.spec_corpus(spark, SOURCE)
    told = spark.sql(corpus.SQL, lineitem=spark.read.parquet(f"{SOURCE}/lineitem.parquet"), part=spark.read.parquet(f"{SOURCE}/part.parquet"))
    assert made.schema.names == told.schema.names and [f.dataType for f in made.schema] == [f.dataType for f in told.schema]
    assert made.exceptAll(told).isEmpty() and told.exceptAll(made).isEmpty()


def test_a_document_meets_before_its_lines_are_told(spark):
    plan = optimized(corpus.spec_corpus(spark, SOURCE))
    assert plan.index("Ambient limit") < plan.index("RepartitionByExpression")


def test_scores_and_levels_read_lines_once(spark):
    for name in ("header_score", "layout_headers"):
        assert optimized(catalog.QUERIES[name](spark, SOURCE)).count("Relation [") == 2, name


def test_windows_leave_what_joins_left(spark):
    kind = "file_id string, page_no int, line_idx int, text string, x0 double, y0 double, page_height double, font_size double, is_bold boolean, is_caps boolean"
    rows = [("a", p, 0, "Running", 10.0, 5.0, 100.0, 9.0, False, False) for p in range(3)]
    rows += [("a", p, 1, f"{p}.1 Pump {p}", 10.0, 50.0, 100.0, 12.0, True, False) for p in range(3)]
    rows += [("a", 0, 2, "running", 10.0, 60.0, 100.0, None, False, False), ("a", 2, 3, "Contents", 10.0, 50.0, 100.0, 9.0, False, False), ("a", 1, 4, None, None, None, None, None, None, None)]
    rows += [(None, 0, 0, "contents", 10.0, 5.0, 100.0, 9.0, False, False), ("b", None, 0, "contents", 1.0, 5.0, None, 9.0, False, False), ("b", 1, 0, "Twice", 1.0, 5.0, None, 9.0, False, False), ("b", 1, 1, "Twice", 1.0, 5.0, None, 9.0, False, False)]
    lines = spark.createDataFrame(rows, kind)
    joined = layout.without_running(lines.join(layout.toc_pages(lines), ["file_id", "page_no"], "left_anti"), layout.running_lines(lines)).join(layout.page_stats(lines), ["file_id", "page_no"], "left")
    made = layout.body_with_stats(lines)
    found, expected = (sorted((tuple(r[c] for c in joined.columns) for r in df.collect()), key=repr) for df in (made, joined.select(*joined.columns)))
    assert found == expected


def test_pages_are_clustered_as_each_alone():
    rng = np.random.default_rng(3)
    for n in (0, 3, 4, 9):
        pages = np.round(rng.choice([50.0, 300.0, 450.0], (200, n)) + rng.normal(0, 20, (200, n)), 1)
        assert layout.columns_of(pages).tolist() == [layout.column_of(list(p)) for p in pages]
