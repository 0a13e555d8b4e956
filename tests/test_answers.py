"""Answers as events, read in micro-batches with repeats, late and failed sections, against the batch answer."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import answers

ROWS = [
    ("a", 1, "1", "Scope", "x #specs#\n- one\n\n two \n-\nNone\n#Specs# y #specs#"),
    ("a", 2, "2", "Rest", "#SPECS# none #specs#"),
    ("b", 1, "1", "Scope", "#specs#- only#specs#"),
    ("b", 2, "2", None, "nothing"),
    ("b", 3, "3", "Never", "#specs#\n- unseen\n#specs#"),
    ("c", 1, None, "No number", None),
    ("d", 1, "1", "s", "#specs#\n- x\n- x\n#specs#"),
    ("d", 2, "1", "s", "#specs#\n- same number\n#specs#"),
]


@pytest.fixture
def events(spark):
    rows = spark.createDataFrame(ROWS, "file_id string, position int, section_number string, section_name string, response string")
    return answers.events_of(rows)


def test_events(events):
    found = sorted(events.collect(), key=lambda r: (r["file_id"], r["seq"]))
    told = [(r["file_id"], r["event"], [s["spec_text"] for s in r["specs"]] if r["specs"] is not None else None) for r in found]
    assert told[:7] == [("a", "request", None), ("a", "response", None), ("a", "processed", ["one", "two"]), ("a", "request", None), ("a", "response", None), ("a", "processed", []), ("a", "complete", ["one", "two"])]
    assert [x[1] for x in told if x[0] == "b"] == ["request", "response", "processed", "request", "response", "error"]
    assert [(r["status"], r["message"]) for r in found if r["event"] == "error"] == [(502, "LLM returned unexpected format for section 2"), (502, "LLM returned unexpected format for section ")]
    ids = [s["spec_id"] for r in found if r["file_id"] == "d" and r["event"] == "complete" for s in r["specs"]]
    assert len(ids) == 3 and ids[0] == ids[1] != ids[2]


def plain(rows):
    return {r["file_id"]: (r["state"], r["message"], r["requested"], r["responded"], r["processed"], list(r["specs"])) for r in rows}


def test_stream_equals_batch(spark, events, tmp_path):
    """Four micro-batches: events shuffled and repeated, ends last; a document whose end never comes."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events.where("not (file_id = 'd' and event = 'complete')").write.parquet(f"{tmp_path}/all")
        everything = spark.read.parquet(f"{tmp_path}/all")
        rows = everything.collect()
        open_, ends = ([r for r in rows if (r["event"] in ("complete", "error")) == x] for x in (False, True))
        rng = random.Random(1)
        twice = open_ + rng.sample(open_, len(open_) // 2)
        rng.shuffle(twice)
        parts = [twice[0::3], twice[1::3], twice[2::3] + ends, rng.sample(open_, 4) + ends[:1]]
        for i, part in enumerate(parts):
            spark.createDataFrame(part, everything.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        told = []
        q = answers.followed(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: told.extend((i, r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    finally:
        spark.conf.set(store, before)
    last = {r["file_id"]: r for _, r in sorted(told, key=lambda x: x[0])}
    assert len({i for i, _ in told}) >= 3 and len(told) > len(last)
    assert plain(last.values()) == plain(answers.known(everything).collect())
    assert {f: x[0] for f, x in plain(last.values()).items()} == {"a": "complete", "b": "failed", "c": "failed", "d": "running"}
    assert answers.known(everything.where(F.lit(False))).collect() == []
