"""Quality rules with adaptive thresholds.

Each document's measures come from its whole text. For each language and source, mergeable quantile summaries of the
measures (built in parts, merged in the shuffle) give thresholds that follow what is usual there, in place of fixed
cutoffs; a join with that small table then filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialize, words

SYMBOLS = "#*$%&|<>"
#: A language's quantiles weigh as much as so many documents of the source beside the source's own.
PRIOR_ROWS = 100
#: Accuracy of the quantile summaries: ranks are right to one in so many.
ACCURACY = 2_000


def repeat_words(w: Column) -> Column:
    """How many of the words stand in a window of three that occurs twice or more.

    The windows' 64-bit hashes find the candidates; windows of equal hash are then compared as text, so that a
    collision counts only if it is none.
    """
    n = F.size(w)
    hashes = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
    )

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
        alike = let(
            ordered,
            lambda s: F.flatten(
                F.zip_with(
                    F.slice(s, F.lit(1), F.size(s) - 1),
                    F.slice(s, F.lit(2), F.size(s) - 1),
                    lambda a, b: F.when(
                        (a["h"] == b["h"]) & (window(a["i"]) == window(b["i"])), F.array(a["i"], b["i"])
                    ).otherwise(F.array().cast("array<int>")),
                )
            ),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(alike, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(n < 4, F.lit(0)).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def measures(docs: DataFrame) -> DataFrame:
    """Adds the column ``m``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_shouts.

    Over the whole text, however long; null is empty and has zeros throughout. A column ``m`` of ``docs`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    m = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")
        ),
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own")))
    return docs.withColumn("m", F.struct(m.alias("w"), line_counts.alias("l"))).withColumn(
        "m",
        F.struct(
            F.col("m.w.n_words").alias("n_words"),
            F.char_length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.col("m.l.all") - F.col("m.l.own")).cast("long").alias("n_dup_lines"),
            F.col("m.w.n_repeat_words").alias("n_repeat_words"),
            F.col("m.l.all").cast("long").alias("n_lines"),
            (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
            (F.char_length(text) - F.char_length(F.translate(text, "!?", ""))).cast("long").alias("n_shouts"),
        ),
    )


def base_failed() -> Column:
    m = F.col("m")
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _ratios() -> dict[str, Column]:
    m = F.col("m")
    w, c, x = (F.greatest(v, F.lit(1)).cast("double") for v in (m["n_words"], m["word_chars"], m["n_lines"]))
    return {
        "symbols": m["n_symbols"] / w,
        "word_length": m["word_chars"] / w,
        "duplicate_lines": m["n_dup_lines"] / x,
        "repeats": m["n_repeat_words"] / w,
        "capitals": m["n_upper"] / c,
        "shouts": m["n_shouts"] / w,
    }


#: For each measure the least distance of a threshold from the upper quartile: differences below it are no fault.
SLACK = {"symbols": 0.1, "word_length": 3.0, "duplicate_lines": 0.6, "repeats": 0.35, "capitals": 0.2, "shouts": 0.15}
#: Interquartile ranges from the quartile to the threshold.
SPREAD = 4.0


def _quantiles(measured: DataFrame, *keys: str) -> DataFrame:
    """``keys``, n and ``q``: each measure's median and upper quartile for each group of the keys' values."""
    cuts = [F.percentile_approx(v, F.array(F.lit(0.5), F.lit(0.75)), ACCURACY).alias(k) for k, v in _ratios().items()]
    q = measured.where(~base_failed()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *cuts)
    return q.select(*keys, "n", F.struct(*_ratios()).alias("q"))


def thresholds(measured: DataFrame) -> DataFrame:
    """A row for each lang and source (null is a value like others) with ``top``: each measure's upper limit.

    ``measured``: lang, source, m. A limit is the upper quartile plus ``SPREAD`` times the distance between median and upper quartile,
    or plus the measure's slack if that is more. Only documents that the base rules accept count. A source's quantiles are drawn
    towards its language's by n / (n + ``PRIOR_ROWS``), at every size: one document says little, many say all.
    """
    own = _quantiles(measured, "lang", "source")
    of_lang = _quantiles(measured, "lang").select(F.col("lang").alias("_of"), F.col("q").alias("_q"))
    n = F.col("n").cast("double")

    def drawn(k: str, i: int) -> Column:
        return (n * F.get(F.col("q")[k], F.lit(i)) + F.lit(float(PRIOR_ROWS)) * F.get(F.col("_q")[k], F.lit(i))) / (n + F.lit(float(PRIOR_ROWS)))

    limits = ((drawn(k, 1) + F.greatest(SPREAD * (drawn(k, 1) - drawn(k, 0)), F.lit(SLACK[k]))).alias(k) for k in _ratios())
    return own.join(of_lang, F.col("lang").eqNullSafe(F.col("_of"))).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*limits).alias("top"))


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows with the columns lang, source and ``m``; nulls in lang or source are values like others.

    The table of limits has a row for each language and source; the optimizer broadcasts it if it is small by its
    measured size and else shuffles.
    """
    fits = [v <= F.coalesce(F.col("top")[k], F.lit(float("inf"))) for k, v in _ratios().items()]
    verdict = ~base_failed()
    for fit in fits:
        verdict = verdict & fit
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return (
        measured.join(limits, on, "left")
        .withColumns({"base_failed": base_failed(), "kept": verdict})
        .drop("_lang", "_source", "top")
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules accept, with their own columns only.

    ``docs``: text, lang, source and any others, of any names. A null text is empty and fails, as does any text under 50 words;
    repeated rows share a verdict; an empty table stays empty. Each text is measured once: rows are written with their measures.
    """
    measured = materialize(measures(docs.select(F.struct("*").alias("_row"), "text", "lang", "source")).drop("text"))
    return judged(measured, thresholds(measured.select("lang", "source", "m"))).where("kept").select("_row.*")
