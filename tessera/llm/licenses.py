"""License scans with a positional index of rare licence words.

The templates' words are indexed by (word, position). Document frequencies over the whole corpus of the templates'
words give their IDF. A template is looked up by the two words of highest IDF of its key phrase; a file without either is done with it.
A hit at place p of a word that stands at position q of a template posts the start p - q; the starts posted by both words are
intersected, and where the whole key phrase stands, the template is found. How much IDF of the template's words stands in
place is its score. Only built-in functions: one pass over the texts for the frequencies, one for the scan, no shuffle of texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, scalar, words

#: A word of lower-cased text: a run of ASCII letters and digits and of characters beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``text``: the notice; ``phrase``: its part that must be complete, at any coverage of the rest."""

    label: str
    text: str
    phrase: str

    def words(self) -> list[str]:
        return self.text.split()

    def phrase_at(self) -> int:
        w, p = self.words(), self.phrase.split()
        return next(i for i in range(len(w)) if w[i : i + len(p)] == p)


#: The base phrases, each a template that is all mandatory.
BASE = (
    Template("mit", "mit license", "mit license"),
    Template("apache", "apache license", "apache license"),
    Template("gpl", "general public license", "general public license"),
)
#: Common notices, in lower case without punctuation.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    Template(
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge",
    ),
    Template("mit-released", "released under the mit license", "under the mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "names of its contributors may be used to endorse or promote products"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    Template("bsl", "distributed under the boost software license version 1 0", "boost software license"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
#: Words of a key phrase that a template is looked up by: the rarest ones.
ANCHORS = 2
#: Decimal digits of a score.
DIGITS = 6


def text_words(text: Column) -> Column:
    """The words of the whole text, null as empty."""
    return words(lower_ascii(F.coalesce(text, F.lit(""))), LICENSE_WORD)


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> dict[str, int]:
    """In how many documents each word of the templates stands; "" counts all. One row, as wide as the fixed vocabulary."""
    vocabulary = sorted({w for t in templates for w in t.words()})
    known = docs.select(F.array_intersect(text_words(F.col("text")), F.array(*map(F.lit, vocabulary))).alias("has"))
    counts = [F.sum(F.array_contains("has", w).cast("long")).alias(f"n{i}") for i, w in enumerate(vocabulary)]
    row = scalar(known.agg(F.count(F.lit(1)).alias("n"), *counts))
    return {"": row["n"]} | {w: row[f"n{i}"] or 0 for i, w in enumerate(vocabulary)}


def idf(frequencies: dict[str, int]) -> dict[str, float]:
    n = frequencies.get("", 0)
    return {w: math.log((n + 1) / (c + 1)) for w, c in frequencies.items() if w}


def _starts(hits: Column, t: Template, anchors: list[int]) -> Column:
    """Where the template would begin by all of its anchors: their postings, intersected."""

    def posted(k: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == t.words()[k]), lambda h: h["i"] - k)

    starts = posted(anchors[0])
    for k in anchors[1:]:
        starts = F.array_intersect(starts, posted(k))
    return starts


def _found(w: Column, hits: Column, t: Template, anchors: list[int], weights: dict[str, float]) -> Column:
    """Structs of start (of the phrase) and score of each place whose key phrase is complete."""
    tokens, at, n = t.words(), t.phrase_at(), len(t.phrase.split())
    phrase = F.array(*map(F.lit, tokens[at : at + n]))
    own = [weights.get(x, 0.0) for x in tokens]
    whole = 0.0
    for x in own:
        whole += x
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("w"), F.lit(v).alias("v")) for k, (x, v) in enumerate(zip(tokens, own, strict=True))))

    def score(start: Column) -> Column:
        # As in SQL, word by word: where the template's words are in all documents, its score is 1.
        if not whole:
            return F.lit(1.0)
        return F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.when(F.get(w, start + p["k"]) == p["w"], p["v"]).otherwise(0.0)) / F.lit(whole)

    complete = F.filter(_starts(hits, t, anchors), lambda s: (s + at >= 0) & (F.slice(w, s + at + 1, n) == phrase))
    return F.transform(complete, lambda s: F.struct((s + at).alias("start"), F.round(score(s), DIGITS).alias("score")))


def scan(docs: DataFrame, frequencies: dict[str, int]) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score to every row of ``docs``; columns of these names go.

    ``frequencies``: of ``document_frequencies``. A null or empty text has no words, no labels and score 0; long texts are
    scanned whole; repeated rows get equal results; other columns stay. ``labels`` has the base labels and those of notices
    whose key phrase is complete, at any coverage of the rest; ``score`` is the largest share of its words' IDF that a notice has in
    place, and 0.5 at least with a base phrase.
    """
    weights = idf(frequencies)

    def anchors(t: Template) -> list[int]:
        """Positions inside the key phrase of its different words of highest IDF."""
        own, at = t.words(), range(t.phrase_at(), t.phrase_at() + len(t.phrase.split()))
        ranked = sorted(at, key=lambda k: (-weights.get(own[k], 0.0), k))
        return [k for i, k in enumerate(ranked) if own[k] not in {own[j] for j in ranked[:i]}][:ANCHORS]

    lookup = {t: anchors(t) for t in BASE + NOTICES}
    rare = sorted({t.words()[k] for t, ks in lookup.items() for k in ks})
    none = F.array().cast("array<struct<start:int,score:double>>")

    def found(w: Column) -> Column:
        at = F.filter(
            F.transform(w, lambda x, i: F.when(x.isin(rare), F.struct(x.alias("w"), i.alias("i")))), lambda h: h.isNotNull()
        )

        def matched(hits: Column) -> Column:
            def places(t: Template) -> Column:
                return F.when(F.size(hits) < ANCHORS, none).otherwise(_found(w, hits, t, lookup[t], weights))

            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                *(places(t).alias(f"b{i}") for i, t in enumerate(BASE)),
                *(places(t).alias(f"m{i}") for i, t in enumerate(NOTICES)),
            )

        return let(at, matched)

    f = F.col("_found")
    base = [f[f"b{i}"] for i in range(len(BASE))]
    more = [f[f"m{i}"] for i in range(len(NOTICES))]
    starts = F.array_sort(F.transform(F.concat(*base), lambda p: p["start"].cast("long")))
    of_base = [F.when(F.size(p) > 0, F.lit(t.label)) for t, p in zip(BASE, base, strict=True)]
    of_more = [F.when(F.size(p) > 0, F.lit(t.label)) for t, p in zip(NOTICES, more, strict=True)]
    best = F.coalesce(F.array_max(F.transform(F.concat(*more), lambda p: p["score"])), F.lit(0.0))
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in made]
    return (
        docs.select(F.struct("*").alias("_row"), let(text_words(F.col("text")), found).alias("_found"))
        .withColumn("_starts", starts)
        .select(
            *kept,
            f["n_words"].alias("n_words"),
            F.size("_starts").cast("long").alias("n_base"),
            F.array_min("_starts").alias("first_word"),
            F.array_max("_starts").alias("last_word"),
            _joined(of_base).alias("base_labels"),
            _joined(of_base + of_more).alias("labels"),
            F.when(F.size("_starts") > 0, F.greatest(best, F.lit(0.5))).otherwise(best).alias("score"),
        )
    )


def _joined(labels: list[Column]) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
