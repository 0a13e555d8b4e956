"""What plans make of a document's lines and headers, they make once."""

from tessera.operators import corpus, headers
from tessera.streaming import answers


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_derived_line_is_made_once_for_all_patterns(spark):
    plan = optimized(headers.rule_headers(corpus.spec_corpus(spark, "/root/testdata/sf0.001")))
    assert plan.count("Ambient limit") == 1


def test_located_makes_headers_once(spark):
    lines = spark.createDataFrame([("f", 0, "1.1 Pumps"), ("f", 1, "text"), ("f", 2, "1.2 Valves")], "file_id string, ord int, line string")
    heads = headers.rule_headers(lines)
    found = headers.located(heads, lines)
    assert optimized(found).count("RLIKE") == optimized(heads).count("RLIKE")
    assert found.columns == [*heads.columns, "start", "n"]
    assert sorted((r.position, r.start, r.n) for r in found.collect()) == [(1, 0, 3), (2, 2, 3)]


def test_located_keeps_repeated_headers_and_files_without_lines(spark):
    lines = spark.createDataFrame([("f", 0, "a pump"), ("f", 1, None)], "file_id string, ord int, line string")
    rows = [("f", 1, "1", "pump"), ("f", 1, "1", "pump"), ("f", 2, None, None), ("g", 1, "1", "pump")]
    heads = spark.createDataFrame(rows, "file_id string, position int, section_number string, section_name string")
    found = [(r.file_id, r.position, r.start, r.n) for r in headers.located(heads, lines).collect()]
    assert sorted(found, key=str) == [("f", 1, 0, 2), ("f", 1, 0, 2), ("f", 2, 0, 2), ("g", 1, None, 0)]


def test_events_and_what_is_known_read_their_input_once(spark, tmp_path):
    rows = [("f", 1, "1", "A", "#specs#\n- x\n#specs#"), ("f", 2, "2", "B", "none"), ("g", 1, "1", "A", None)]
    spark.createDataFrame(rows, "file_id string, position int, section_number string, section_name string, response string").write.parquet(f"{tmp_path}/answers")
    told = answers.events_of(spark.read.parquet(f"{tmp_path}/answers"))
    assert optimized(told).count("Relation [") == 1
    assert sorted((r.file_id, r.seq, r.event) for r in told.collect()) == [
        ("f", 3, "request"), ("f", 4, "response"), ("f", 5, "processed"), ("f", 6, "request"), ("f", 7, "response"), ("f", 8, "error"),
        ("g", 3, "request"), ("g", 4, "response"), ("g", 5, "error"),
    ]
    told.write.parquet(f"{tmp_path}/events")
    assert optimized(answers.known(spark.read.parquet(f"{tmp_path}/events"))).count("Relation [") == 1
