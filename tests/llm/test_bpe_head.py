"""The dictionary of frequent words: what is in it is found by Spark's hashes, and nothing else."""

import pyarrow as pa

from tessera.llm import bpe


def found(spark, rows, asked):
    head = bpe.Head(bpe.Head.shared(spark.createDataFrame(rows, "word string, ids string")))
    return head.find(pa.array(asked, pa.string()), asked)


def test_words_of_the_dictionary_are_found(spark):
    rows = [(w, str(i)) for i, w in enumerate(["a", " the", "größe", "\U0001f600", "", *(f"w{i}" for i in range(20_000))])]
    asked = [w for w, _ in rows] + ["b", "the", "w20000"]
    assert found(spark, rows, asked) == [i for _, i in rows] + [None] * 3


def test_an_empty_dictionary_finds_nothing(spark):
    assert found(spark, [], ["a", ""]) == [None, None]
