"""Hooks for models: callables over prompts and texts, deterministic by default."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import search

#: Attempts at a call, and seconds to wait after each, times the attempt's number.
ATTEMPTS, BACKOFF = 3, 1.5


def generated(prompts: Column, model: Callable[[str], str] | None = None, wait: float = BACKOFF) -> Column:
    """The model's answers, tried ``ATTEMPTS`` times; without a model empty answers."""
    if model is None:
        return F.lit("")

    def answer(prompt: str) -> str:
        for k in range(1, ATTEMPTS + 1):
            try:
                return model(prompt)
            except Exception:
                if k == ATTEMPTS:
                    raise
                time.sleep(wait * k)
        return ""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(answer, na_action="ignore")

    return run(prompts)


def embedded(texts: Column, model: Callable[[list[str]], list[list[float]]] | None = None) -> Column:
    """Unit vectors by a model over batches of texts; without one hash embeddings."""
    if model is None:
        return search.embedding(texts)

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in model(s.fillna("").tolist())], index=s.index)

    return search.normalized(run(texts))


def outline_prompt(lines: DataFrame, budget: int = 4000) -> DataFrame:
    """file_id, prompt: a document's first lines within a budget of characters."""
    from pyspark.sql import Window as W

    so_far = F.sum(F.char_length("line") + 1).over(W.partitionBy("file_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    rows = F.array_sort(F.collect_list(F.struct("ord", "line")))
    head = "List the headers of this document as a numbered nested list.\n\n"
    return lines.withColumn("n", so_far).where(F.col("n") <= budget).groupBy("file_id").agg(
        F.concat(F.lit(head), F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("prompt")
    )


def spec_lines(answers: DataFrame) -> DataFrame:
    """file_id, at, spec_text from answers (file_id, answer): the lines between #specs# fences, dashes off, NONE for none."""
    body = F.regexp_extract("answer", r"(?is)#specs#(.*?)(?:#specs#|#specs_end#)", 1)
    each = answers.select("file_id", F.posexplode(F.transform(T.lines(body), T.strip)).alias("at", "line"))
    said = F.regexp_replace("line", r"^[-•*]\s*", "")
    return each.select("file_id", "at", T.strip(said).alias("spec_text")).where("spec_text <> '' and upper(spec_text) <> 'NONE'")


def message_text(payload: Column) -> Column:
    """The answer's text from a chat service's JSON: the first of the usual places that has one."""
    places = ("$.choices[0].message.content", "$.choices[0].text", "$.message.content", "$.content", "$.response")
    return F.coalesce(*(F.nullif(F.get_json_object(payload, p), F.lit("")) for p in places))
