"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, language_model, licenses, mixing, oracles, prefix_trie, quality, repeats, secrets, sharding, simhash, sketches, toxicity
from .common import WORD, documents, materialize


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sorted, truncated mix takes of each document. Null texts and texts without words take nothing; a null source is one."""
    rows = documents(spark, sf_dir).select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("shuffle_key"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    out = mixing.mixture(mixing.schedule(materialize(rows)))
    return out.groupBy("row_id", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.min("virtual_finish").alias("virtual_finish")).drop("row_id")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return bpe.round_trip(documents(spark, sf_dir), codec, public_tokenizers.PATTERN)


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(materialize(sharding.sized(documents(spark, sf_dir))), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licenses.scan(docs, licenses.document_frequencies(docs)).drop("text")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return language_model.score(docs, language_model.train(docs.where(~language_model.held_out(F.col("doc_id"))).select("text")))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_and_compare(documents(spark, sf_dir))


def op9_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(quality.measures(documents(spark, sf_dir).select("doc_id", "lang", "source", "text")).drop("text"))
    out = quality.judged(measured, quality.thresholds(measured))
    m = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col("m")[k].alias(k) for k in m), "base_failed", "kept")


def op11_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, bytes removed, spans and the digest of what is left. Null and empty texts have none; rows of equal doc_id go by their text's hash."""
    out = repeats.without_repeats(documents(spark, sf_dir))
    n = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")
    return out.select(
        "row.doc_id",
        n.alias("n_bytes"),
        (n - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repair of the damaged conversations found and did; a conversation that lost all rows has zeros. Nulls are one space."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.summaries(conversations.damaged(rows), rows)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations. Rows of a null conv_id are left out; no conversation, no node."""
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {
    f.__name__: f for f in (
        op1_mix_sources,
        op2_bpe_round_trip,
        op3_shard,
        op4_toxicity,
        op5_scan_licenses,
        op6_simhash_dedup,
        op7_lm_score,
        op8_fingerprint,
        op9_find_secrets,
        op10_quality_rules,
        op11_remove_repeats,
        op12_repair_conversations,
        op13_prefix_trie,
    )
}

def _op10_sql() -> str:
    """The same rows by SQL. Its quantiles are exact, as the summaries are up to ``quality.ACCURACY`` rows of a group."""
    ratio = {
        "symbols": "n_symbols / greatest(n_words, 1)::DOUBLE",
        "word_length": "word_chars / greatest(n_words, 1)::DOUBLE",
        "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
        "repeats": "n_repeat_words / greatest(n_words, 1)::DOUBLE",
        "capitals": "n_upper / greatest(word_chars, 1)::DOUBLE",
        "shouts": "n_shouts / greatest(n_words, 1)::DOUBLE",
    }
    quantiles = ", ".join(f"quantile_disc({k}, {q}) AS {k}_{name}" for k in ratio for name, q in (("h", 0.5), ("u", 0.75)))

    def drawn(k: str, name: str) -> str:
        prior = f"{float(quality.PRIOR_ROWS)!r}::DOUBLE"
        return f"((s.n::DOUBLE * s.{k}_{name} + {prior} * l.{k}_{name}) / (s.n::DOUBLE + {prior}))"

    fits = " AND ".join(
        f"m.{k} <= {drawn(k, 'u')} + greatest({quality.SPREAD!r}::DOUBLE * ({drawn(k, 'u')} - {drawn(k, 'h')}), {quality.SLACK[k]!r}::DOUBLE)" for k in ratio
    )
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM again CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
base AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(lines) AS n_lines, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper, length(text) - length(translate(text, '!?', '')) AS n_shouts
  FROM w LEFT JOIN covered c USING (r)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{v} AS {k}" for k, v in ratio.items())} FROM base),
s AS (SELECT lang, source, count(*) AS n, {quantiles} FROM m WHERE NOT base_failed GROUP BY lang, source),
l AS (SELECT lang, {quantiles} FROM m WHERE NOT base_failed GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({fits}, true) AS kept
FROM m LEFT JOIN s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang"""


def _op5_sql() -> str:
    """The same rows by SQL: every place of every key phrase by comparison, without an index."""
    templates = [(t, f"b{i}") for i, t in enumerate(licenses.BASE)] + [(t, f"m{i}") for i, t in enumerate(licenses.NOTICES)]
    upper = "".join(map(chr, range(65, 91)))
    number = {x: i for i, x in enumerate(sorted({x for t, _ in templates for x in t.words()}))}
    weights = ", ".join(f"ln((count(*) + 1)::DOUBLE / (count(*) FILTER (list_contains(w, '{x}')) + 1)::DOUBLE) AS i{i}" for x, i in number.items())

    def places(t: licenses.Template) -> str:
        tokens, at = t.words(), t.phrase_at()
        phrase = " AND ".join(f"w[p + {k + 1}] = '{x}'" for k, x in enumerate(t.phrase.split()))
        found = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN p + {k - at} >= 0 AND w[p + {k - at + 1}] = '{x}' THEN i{number[x]} ELSE 0.0::DOUBLE END" for k, x in enumerate(tokens))])
        whole = " + ".join(["0.0::DOUBLE", *(f"i{number[x]}" for x in tokens)])
        score = f"CASE WHEN {whole} = 0 THEN 1.0::DOUBLE ELSE round(({found}) / ({whole}), {licenses.DIGITS}) END"
        return f"list_transform(list_filter(range(0, len(w)), lambda p: p >= {at} AND {phrase}), lambda p: {{'start': p, 'score': {score}}})"

    columns = ", ".join(f"{places(t)} AS {name}" for t, name in templates)
    base = [name for _, name in templates if name[0] == "b"]
    starts = "list_sort(list_transform(" + " || ".join(base) + ", lambda x: x.start))"
    scores = "list_max(list_transform(" + " || ".join(name for _, name in templates if name[0] == "m") + ", lambda x: x.score))"

    def labels(prefixes: str) -> str:
        said = ", ".join(f"CASE WHEN len({name}) > 0 THEN '{t.label}' END" for t, name in templates if name[0] in prefixes)
        return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{said}], lambda x: x IS NOT NULL))), ','), '')"

    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{licenses.LICENSE_WORD}') AS w FROM documents),
i AS (SELECT {weights} FROM t),
f AS (SELECT doc_id, len(w) AS n_words, {columns} FROM t CROSS JOIN i), g AS (SELECT *, {starts} AS starts, coalesce({scores}, 0.0::DOUBLE) AS best FROM f)
SELECT doc_id, n_words, len(starts) AS n_base, starts[1] AS first_word, starts[-1] AS last_word, {labels("b")} AS base_labels, {labels("bm")} AS labels,
  CASE WHEN len(starts) > 0 THEN greatest(best, 0.5::DOUBLE) ELSE best END AS score FROM g"""


#: The other queries rest on hashes, samples or models that SQL hasn't: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_scan_licenses": _op5_sql(),
    "op10_quality_rules": _op10_sql(),
    "op11_remove_repeats": oracles.OP11,
    "op12_repair_conversations": oracles.OP12,
    "op13_prefix_trie": oracles.OP13,
}
