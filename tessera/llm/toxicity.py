"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words; a document's is the noisy-or of its
sentences', one minus the product of what each leaves. Only documents carry labels; training pushes their
blame down to sentences, and the sentences with the highest probabilities locate what offends.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scalar, tidy, unit_interval

#: Bounds of the sample that the model is fitted on: labelled documents and UTF-8 bytes of their text.
MAX_DOCUMENTS, MAX_BYTES = 10_000, 48_000_000
#: Words of the model at most, and documents that a word must be in.
MAX_WORDS, LEAST_DOCUMENTS = 20_000, 4

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def sentence(self, text: str) -> float:
        """The sentence's log-odds; each word counts once."""
        get = self.weights.get
        return self.bias + sum(w for w in (get(t) for t in set(_TOKEN.findall(text.lower()))) if w)

    def score(self, text: str) -> float:
        """The whole text's noisy-or; a text without words has the probability of an empty sentence."""
        left, plain, n = 0.0, np.logaddexp(0.0, self.bias), 0
        # Sentences without a word of the model all weigh the same: they are counted.
        known = self.weights
        for m in _SENTENCE.finditer(text):
            n += 1
            tokens = _TOKEN.findall(m[0].lower())
            if not known.keys().isdisjoint(tokens):
                left += float(np.logaddexp(0.0, self.bias + sum(known[t] for t in set(tokens) if t in known))) - plain
        return float(1.0 - np.exp(-(left + max(n, 1) * plain)))

    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that reach ``least``, in code points."""
        out = []
        for m in _SENTENCE.finditer(text):
            p = 1.0 / (1.0 + np.exp(-self.sentence(m[0])))
            if p >= least:
                out.append((m.start(), m.end(), float(p)))
        return out


def fit(texts: list[str], labels: list[int], rounds: int = 300, rate: float = 0.3, ridge: float = 2e-3) -> Model:
    """Fits word weights and bias to document labels by full-batch gradient steps on the noisy-or likelihood.

    Words are those of several documents whose log-odds of standing in labelled ones is clear of its standard error;
    that log-odds is the starting weight. Without both labels the model is a constant.
    """
    y = np.array(labels, dtype=np.float64)
    rate_of_1 = (y.sum() + 0.5) / (len(y) + 1.0)
    if not len(y) or y.min() == y.max():
        return Model({}, float(np.log(rate_of_1 / (1 - rate_of_1))) if len(y) else -3.0)
    inside: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, labels, strict=True):
        inside[label].update(set(_TOKEN.findall(text.lower())))
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = {}
    for w in inside[0].keys() | inside[1].keys():
        a, b = inside[1][w], inside[0][w]
        if a + b >= LEAST_DOCUMENTS:
            value = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
            error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
            if abs(value) > 3 * error:
                odds[w] = (value, abs(value) / error)
    vocabulary = sorted(odds, key=lambda w: (-odds[w][1], w))[:MAX_WORDS]
    index = {w: i for i, w in enumerate(vocabulary)}
    # Sentences with words of the model, one after another; the rest of a document are counted. Texts are read again:
    # their words as sets would take many times their size.
    inside[0].clear()
    inside[1].clear()
    rows, columns, owner, plain = array("l"), array("l"), array("l"), np.zeros(len(texts))
    for d, text in enumerate(texts):
        sentences = 0
        for m in _SENTENCE.finditer(text):
            sentences += 1
            hit = {index[t] for t in _TOKEN.findall(m[0].lower()) if t in index}
            if hit:
                rows.extend([len(owner)] * len(hit))
                columns.extend(sorted(hit))
                owner.append(d)
            else:
                plain[d] += 1
        plain[d] = max(plain[d], 0 if sentences else 1)
    rows, columns, owner = (np.array(x, dtype=np.int64) for x in (rows, columns, owner))
    w, b = np.array([odds[x][0] for x in vocabulary]), -6.0
    start = w.copy()
    seen_w, seen_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(rows, w[columns], len(owner)) if len(owner) else np.zeros(0)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        left = np.bincount(owner, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, b)
        doc = np.clip(-np.expm1(-left), 1e-9, 1 - 1e-9)
        # d loss / d left: left is what the noisy-or multiplies up, as a negative logarithm.
        pull = (1 - y) - y * (1 - doc) / doc
        g = pull[owner] * p if len(owner) else z
        gw = np.bincount(columns, g[rows], len(w)) / len(y) + ridge * (w - start) / np.sqrt(len(y))
        gb = (g.sum() + (pull * plain).sum() * p0) / len(y)
        seen_w += gw**2
        seen_b += gb**2
        w -= rate * gw / np.sqrt(seen_w)
        b -= rate * gb / np.sqrt(seen_b)
    return Model({x: float(v) for x, v in zip(vocabulary, w, strict=True)}, float(b))


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of labelled documents that aren't held out: all of them up to the documented bounds, else a sample by hash.

    Null ids, labels and texts don't count; of repeated labels the largest does.
    """
    own = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 2))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    n = own.count()
    u = unit_interval(F.xxhash64("doc_id", F.lit(11)))
    chosen = own.where(u < min(1.0, 0.98 * MAX_DOCUMENTS / max(n, 1)))  # at most the bound but for chance
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    size = scalar(rows.agg(F.sum(F.octet_length("text"))))[0] or 0
    if size > MAX_BYTES:
        rows = rows.where(unit_interval(F.xxhash64("doc_id", F.lit(13))) < MAX_BYTES / size)
    return rows.select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in training_rows(docs, labels).collect())
    return fit([r[1] for r in rows], [int(r[2] > 0) for r in rows])


def model_spans(model: Model, text: str) -> list[tuple[int, int, float]]:
    """The sentences that ``Model.offending`` finds, else the one of the highest probability."""
    return model.offending(text) or sorted(model.offending(text, 0.0), key=lambda x: -x[2])[:1]


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, offending for every row of ``docs`` (doc_id, text).

    The last has the places, in code points, of the sentences that offend if the document is predicted, else none. A null or
    empty text gets the score of an empty sentence; a null doc_id isn't held out; repeated rows each have a row.
    """
    schema = docs.select("doc_id").schema
    for name, kind in (("held_out", "boolean"), ("score", "double"), ("predicted", "integer"), ("offending", "array<struct<start:int,end:int,probability:double>>")):
        schema = schema.add(name, docs.sparkSession.range(0).selectExpr(f"cast(null as {kind}) x").schema["x"].dataType)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # MAX_WORDS words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores, at = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                scores.append(own.score(text))
                # Sentences that offend by themselves; where none does, the one that says most.
                spans = model_spans(own, text) if scores[-1] >= threshold else []
                at.append([{"start": a, "end": b, "probability": p} for a, b, p in spans])
            predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
            places = [pa.array(at, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted, *places], names=schema.names)

    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(tidy(run), schema)
