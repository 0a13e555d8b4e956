"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity, specs, text
from ..operators import atomize, corpus, documents, export, headers, layout, lines, matching, page_lines, quality, search, toc
from . import sequences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that must give its rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments for the engine that checks: its regular expressions are RE2, with ASCII classes.
def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _fold(x: str) -> str:
    return rf"lower(regexp_replace({_strip(x)}, '\s+', ' ', 'g'))"


CORPUS = f"corpus AS ({corpus.oracle()})"
_TOC = r"(?i)^\s*.+?[.\s․…⋯·‧]*[.․…⋯·‧][.\s․…⋯·‧]*(\d{1,4}|[ivxlcdm]{1,8})\s*$"
_CLEAN = _strip(rf"regexp_replace(regexp_replace({_strip('line')}, '^[-•*]+\s*', ''), '^\d+(?:\.\d+)*[.)]\s*', '')")
_TRIGGER = _q("|".join(specs.TRIGGERS))
_UNIT = _q(specs.VALUE_UNIT)


def _case(token: str, values: dict, other: str) -> str:
    return f"CASE {token} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


_FACTOR = _case("token", {k: repr(f) for k, (_, f) in specs.CONVERSIONS.items()}, "NULL")
_NAME = _case("token", {k: f"'{u}'" for k, (u, _) in specs.CONVERSIONS.items()}, "'degC'")
_HINT = _case("lower(normalized_unit)", {k: f"'{v}'" for k, v in specs.UNIT_CATEGORY.items()}, "NULL")
_WORDS = "CASE " + " ".join(f"WHEN regexp_matches(lower(spec_text), {_q(specs.keyword_pattern(c))}) THEN '{c}'" for c in specs.KEYWORDS) + " ELSE 'unknown' END"
ATOMS = f"""{CORPUS},
cleaned AS (SELECT file_id, section_id, {_CLEAN} AS spec_text FROM corpus),
found AS (SELECT *, regexp_extract(spec_text, {_UNIT}, 1) AS raw, regexp_extract(spec_text, {_UNIT}, 2) AS unit
  FROM cleaned WHERE spec_text <> '' AND (regexp_matches(lower(spec_text), {_TRIGGER}) OR regexp_matches(spec_text, {_UNIT}))),
tokened AS (SELECT *, lower(replace(unit, ' ', '')) AS token, TRY_CAST(raw AS DOUBLE) AS value FROM found),
valued AS (SELECT *, CASE WHEN unit <> '' THEN concat_ws(' ', raw, trim(unit)) END AS raw_value,
  CASE WHEN unit = '' THEN NULL WHEN token IN ('°c', 'degc') THEN value WHEN token IN ('°f', 'degf') THEN round((value - 32.0) * 5.0 / 9.0, 4)
    ELSE round(value * ({_FACTOR}), 4) END AS normalized_value,
  CASE WHEN unit = '' THEN NULL ELSE {_NAME} END AS normalized_unit FROM tokened),
grouped AS (SELECT *, coalesce({_HINT}, {_WORDS}) AS category FROM valued),
atoms AS (SELECT concat('spec-', substr(sha1(concat(file_id, ':', section_id, ':', spec_text)), 1, 12)) AS spec_id, file_id, section_id, spec_text,
  raw_value, normalized_value, normalized_unit, category,
  round(least(1.0::DOUBLE, CASE WHEN regexp_matches(lower(spec_text), 'shall|must|required') THEN 0.9::DOUBLE
    WHEN regexp_matches(lower(spec_text), 'should|ensure|include') THEN 0.75 WHEN regexp_matches(spec_text, {_UNIT}) THEN 0.65 ELSE 0.5 END
    + (CASE WHEN raw_value IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN category <> 'unknown' THEN 0.05::DOUBLE ELSE 0 END)), 2) AS confidence FROM grouped)"""


@query(f"WITH {ATOMS} SELECT * FROM atoms")
def spec_atomize(spark, sf_dir):
    return atomize.atomize(corpus.spec_corpus(spark, sf_dir))


@query(f"WITH {ATOMS} SELECT category, count(*) AS n, count(DISTINCT spec_id) AS ids, round(avg(confidence), 6) AS mean_confidence FROM atoms GROUP BY category")
def spec_by_category(spark, sf_dir):
    return spec_atomize(spark, sf_dir).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("spec_id").alias("ids"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


@query(
    f"WITH {ATOMS} SELECT normalized_unit, count(*) AS n, min(normalized_value) AS low, max(normalized_value) AS high, round(avg(normalized_value), 4) AS mean "
    "FROM atoms WHERE normalized_unit IS NOT NULL GROUP BY normalized_unit"
)
def spec_unit_summary(spark, sf_dir):
    v = F.col("normalized_value")
    return (
        spec_atomize(spark, sf_dir)
        .where("normalized_unit is not null")
        .groupBy("normalized_unit")
        .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 4).alias("mean"))
    )


_RAW = _strip("line")
_NORMAL = _strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_RAW}, '^[-•*]\s+', ''), '^\d+(?:\.\d+)*[.)]\s*', ''), '^\d+(?:\.\d+)*\s+', ''), '[.;:,]+$', '')")
LEAVES = f"""{CORPUS},
picked AS (SELECT file_id, section_id, ord, {_NORMAL} AS spec_text FROM corpus WHERE {_RAW} <> '' AND (regexp_matches({_RAW}, {_q(specs.FALLBACK_UNIT)})
  OR regexp_matches({_RAW}, {_q(specs.FALLBACK_STANDARD)}) OR regexp_matches({_RAW}, {_q(specs.FALLBACK_BULLET)}))),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id, section_id ORDER BY ord) - 1 AS INT) AS spec_index FROM picked WHERE spec_text <> ''),
leaf AS (SELECT sha1(concat(file_id, '|', section_id, '|', spec_index, '|', spec_text)) AS spec_id, file_id, section_id, ord, spec_index, spec_text
  FROM numbered WHERE spec_index < 5)"""


@query(f"WITH {LEAVES} SELECT * FROM leaf")
def leaf_fallback_specs(spark, sf_dir):
    return atomize.fallback_specs(corpus.spec_corpus(spark, sf_dir))


_SOURCES = "sources AS (SELECT file_id, section_id, string_agg(concat(file_id, '-txt-', lpad(CAST(ord AS VARCHAR), 6, '0')), ',' ORDER BY ord) AS ids FROM corpus GROUP BY file_id, section_id)"


@query(
    f"WITH {LEAVES}, {_SOURCES} SELECT spec_id, file_id, section_id, spec_text, ids AS source_ids FROM (SELECT l.*, s.ids, row_number() OVER "
    "(PARTITION BY l.file_id, s.ids, lower(spec_text) ORDER BY ord, spec_index) AS r FROM leaf l JOIN sources s USING (file_id, section_id)) WHERE r = 1"
)
def spec_dedup(spark, sf_dir):
    rows = corpus.spec_corpus(spark, sf_dir)
    kept = atomize.dedup_specs(atomize.fallback_specs(rows), atomize.section_sources(rows))
    return kept.select("spec_id", "file_id", "section_id", "spec_text", F.array_join("source_object_ids", ",").alias("source_ids"))


DOC_LINES = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_index FROM documents),
doc_lines AS (SELECT doc_id, CAST(line_index AS INT) AS line_index, {_strip('x')} AS line FROM raw WHERE {_strip('x')} <> '')"""


@query(f"WITH {DOC_LINES} SELECT doc_id, line_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_index) - 1 AS INT) AS line_no, line FROM doc_lines")
def doc_lines(spark, sf_dir):
    return lines.document_lines(table(spark, sf_dir, "documents"))


@query(f"WITH {DOC_LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY line_index) AS text FROM doc_lines GROUP BY doc_id")
def doc_text_concat(spark, sf_dir):
    return lines.joined(lines.document_lines(table(spark, sf_dir, "documents")), "doc_id", "line_index", "line")


@query(
    rf"SELECT doc_id, {_fold('text')} AS folded, lower(trim(regexp_replace(text, '[^0-9A-Za-z]+', ' ', 'g'))) AS match_key, "
    r"regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1-\2', 'g'), '([\p{L}\p{N}_])-\n([a-z])', '\1\2', 'g'), '\s{2,}', ' ', 'g') AS fixed FROM documents"
)
def text_normalize(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_spaces(c).alias("folded"), text.match_key(c).alias("match_key"), text.fix_ocr(c).alias("fixed"))


@query(
    f"WITH {DOC_LINES}, per AS (SELECT doc_id, line, count(*) AS n FROM doc_lines GROUP BY doc_id, line), "
    "sized AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS size FROM per) SELECT doc_id, line, n FROM sized WHERE n > greatest(size // 8, 10)"
)
def repeated_line_ban(spark, sf_dir):
    return lines.repeated_lines(lines.document_lines(table(spark, sf_dir, "documents")), "doc_id")


# Contents pages: the corpus with a page for each section.
def _pages(spark, sf_dir):
    return corpus.spec_corpus(spark, sf_dir).select("file_id", (F.col("section_no") - 1).alias("page"), "line_idx", "line")


PAGES = f"""{CORPUS}, pages0 AS (SELECT file_id, section_no - 1 AS page, line_idx, line, regexp_matches({_strip('line')}, {_q(_TOC)}) AS entry,
  regexp_matches(line, '(?i)^\\s*(table\\s+of\\s+)?contents\\s*$') AS heading FROM corpus),
per_page AS (SELECT file_id, page, sum(entry::INT) AS hits, max(heading::INT) AS heading FROM pages0 WHERE page < 10 GROUP BY file_id, page),
stay AS (SELECT *, page - row_number() OVER (PARTITION BY file_id ORDER BY page) AS run FROM per_page WHERE hits >= 2 OR heading = 1),
toc_pages AS (SELECT file_id, page FROM (SELECT *, max(CASE WHEN hits >= 3 OR heading = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, run ORDER BY page) AS inside FROM stay) WHERE inside = 1)"""


@query(f"WITH {PAGES} SELECT file_id, page, line_idx, line FROM pages0 WHERE entry")
def toc_lines(spark, sf_dir):
    return _pages(spark, sf_dir).where(text.is_toc_entry(F.col("line")))


@query(f"WITH {PAGES} SELECT * FROM toc_pages")
def toc_pages(spark, sf_dir):
    return toc.toc_pages(_pages(spark, sf_dir))


@query(f"WITH {PAGES} SELECT file_id, page, line_idx, line FROM pages0 ANTI JOIN toc_pages USING (file_id, page) WHERE NOT entry")
def real_header_lines(spark, sf_dir):
    return toc.real_header_lines(_pages(spark, sf_dir))


_GLYPHS = r"(?i)([._·•⋅…—–-]{2,}).{0,12}(\d{1,4}|[IVXLCDM]{1,7})\s*$"


@query(
    f"WITH {CORPUS} SELECT DISTINCT line FROM corpus WHERE regexp_matches({_RAW}, {_q(_TOC)}) OR regexp_matches({_RAW}, {_q(_GLYPHS)}) "
    rf"OR regexp_matches({_RAW}, '(?i)\b[ivxlcdm]{{1,8}}\s*$')"
)
def anchor_toc_lines(spark, sf_dir):
    return corpus.spec_corpus(spark, sf_dir).where(text.is_toc_line(F.col("line"))).select("line").distinct()


# Headers by rules and the sections they open.
_RULE = "CASE " + " ".join(f"WHEN regexp_matches(s, {_q(r)}) THEN trim(regexp_extract(s, {_q(r)}, 1))" for r in headers.RULES) + " END"
HEADERS = f"""{CORPUS}, titled AS (SELECT file_id, ord, {_RULE} AS title FROM (SELECT *, {_RAW} AS s FROM corpus) WHERE s <> '' AND NOT regexp_matches(s, {_q(headers.TOCY)})),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, lower(title) ORDER BY ord) AS again FROM titled WHERE title IS NOT NULL) WHERE again = 1),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY ord) AS INT) AS position FROM firsts),
headers AS (SELECT file_id, ord, position, CASE WHEN regexp_matches(title, {_q(text.SECTION_LINE)}) THEN regexp_extract(title, {_q(text.SECTION_LINE)}, 1) ELSE CAST(position AS VARCHAR) END AS section_number,
  CASE WHEN regexp_matches(title, {_q(text.SECTION_LINE)}) THEN {_strip(f"regexp_extract(title, {_q(text.SECTION_LINE)}, 2)")} ELSE title END AS section_name FROM placed)"""


def _headers(spark, sf_dir):
    return headers.rule_headers(corpus.spec_corpus(spark, sf_dir))


@query(f"WITH {HEADERS} SELECT * FROM headers")
def rule_headers(spark, sf_dir):
    return _headers(spark, sf_dir)


@query(
    f"WITH {HEADERS} SELECT file_id, concat('#headers#', chr(10), string_agg(trim(concat_ws(' ', section_number, section_name)), chr(10) ORDER BY position), chr(10), '#headers#') AS block FROM headers GROUP BY file_id"
)
def header_blocks(spark, sf_dir):
    return headers.header_block(_headers(spark, sf_dir))


@query(
    f"WITH {HEADERS}, said AS (SELECT file_id, position, trim(concat_ws(' ', section_number, section_name)) AS l FROM headers) SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY position) AS INT) AS at, "
    f"regexp_extract(l, {_q(text.SECTION_LINE)}, 1) AS section_number, {_strip(f'regexp_extract(l, {_q(text.SECTION_LINE)}, 2)')} AS section_name FROM said WHERE regexp_matches(l, {_q(text.SECTION_LINE)})"
)
def parsed_header_blocks(spark, sf_dir):
    return headers.parse_header_block(headers.header_block(_headers(spark, sf_dir)))


def _cut(pattern: str) -> tuple[str, str]:
    token = f"regexp_extract(t, {_q(pattern)})"
    rest = f"substr(t, length({token}) + 1)"
    bare = rf"regexp_replace({rest}, '^[ )\-.]+', '')"
    return rf"regexp_replace({token}, '[.\-]+$', '')", f"CASE WHEN {bare} <> '' THEN {bare} ELSE trim({rest}) END"


_CUTS = [(p, *_cut(p)) for p in (text.NUMBER, text.ROMAN, text.ALPHA)]
_N = "CASE " + " ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN {number}" for p, number, _ in _CUTS) + " ELSE NULL END"
_T = "CASE " + " ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN {title}" for p, _, title in _CUTS) + " ELSE t END"
NUMBERS = f"""{CORPUS}, texts AS (SELECT DISTINCT line, trim(line) AS t FROM corpus),
split AS (SELECT line, {_N} AS number, {_T} AS title FROM texts)"""
_SEGMENTS = r"len(list_filter(string_split(regexp_replace(number, '[.\-]+$', ''), '.'), lambda x: x <> ''))"


@query(f"WITH {NUMBERS} SELECT * FROM split")
def header_number_split(spark, sf_dir):
    cut = text.split_number(F.col("line"))
    return corpus.spec_corpus(spark, sf_dir).select("line").distinct().select("line", cut["number"].alias("number"), cut["title"].alias("title"))


@query(
    rf"WITH {NUMBERS} SELECT DISTINCT number, CAST(CASE WHEN regexp_matches(regexp_replace(number, '[.\-]+$', ''), '^\p{{L}}$') THEN 2 WHEN {_SEGMENTS} = 0 THEN 1 "
    rf"WHEN {_SEGMENTS} > 1 AND regexp_matches(number, '^\p{{L}}\.') THEN {_SEGMENTS} + 1 ELSE {_SEGMENTS} END AS INT) AS segments FROM split WHERE number IS NOT NULL"
)
def segment_count(spark, sf_dir):
    return header_number_split(spark, sf_dir).where("number is not null").select("number").distinct().withColumn("segments", text.segment_count(F.col("number")))


_LEVEL = "CAST(least(greatest(len(string_split(section_number, '.')), 1), 6) AS INT)"
TREE = f"""{HEADERS}, leveled AS (SELECT *, {_LEVEL} AS level FROM headers),
up AS (SELECT c.file_id, c.position, max(p.position) AS parent FROM leveled c JOIN leveled p ON p.file_id = c.file_id AND p.position < c.position AND p.level < c.level GROUP BY c.file_id, c.position),
down AS (SELECT c.file_id, c.position, min(p.position) AS follower FROM leveled c JOIN leveled p ON p.file_id = c.file_id AND p.position > c.position AND p.level <= c.level GROUP BY c.file_id, c.position),
sized AS (SELECT file_id, max(position) AS n FROM headers GROUP BY file_id),
tree0 AS (SELECT l.*, u.parent, coalesce(d.follower, s.n + 1) - 1 AS last FROM leveled l LEFT JOIN up u USING (file_id, position) LEFT JOIN down d USING (file_id, position) JOIN sized s USING (file_id)),
paths AS (SELECT file_id, position, trim(concat_ws(' ', section_number, section_name)) AS path FROM tree0 WHERE parent IS NULL
  UNION ALL SELECT t.file_id, t.position, concat(p.path, ' / ', trim(concat_ws(' ', t.section_number, t.section_name))) FROM tree0 t JOIN paths p ON p.file_id = t.file_id AND p.position = t.parent)"""


def _tree(spark, sf_dir):
    return headers.section_tree(headers.leveled(_headers(spark, sf_dir)))


@query(f"WITH RECURSIVE {TREE} SELECT file_id, position, level, CAST(parent AS INT) AS parent, CAST(last AS INT) AS last FROM tree0")
def section_tree(spark, sf_dir):
    return _tree(spark, sf_dir).select("file_id", "position", "level", "parent", "last")


@query(f"WITH RECURSIVE {TREE} SELECT file_id, position, path FROM paths")
def header_paths(spark, sf_dir):
    return _tree(spark, sf_dir).select("file_id", "position", "path")


@query(
    f"WITH RECURSIVE {TREE}, heads AS (SELECT file_id, position AS h, ord AS a, lead(ord) OVER (PARTITION BY file_id ORDER BY position) AS b, last FROM tree0), "
    "own AS (SELECT c.file_id, h, c.ord FROM corpus c JOIN heads ON heads.file_id = c.file_id AND c.ord > a AND (b IS NULL OR c.ord < b) WHERE last = h) "
    "SELECT t.file_id, t.position, count(*) AS n_objects, string_agg(CAST(o.ord AS VARCHAR), ',' ORDER BY o.ord) AS objects FROM tree0 t JOIN own o ON o.file_id = t.file_id AND o.h BETWEEN t.position AND t.last GROUP BY t.file_id, t.position"
)
def section_chunks(spark, sf_dir):
    tree = headers.section_tree(headers.leveled(_headers(spark, sf_dir)), ancestors=True)
    return headers.section_chunks(tree, corpus.spec_corpus(spark, sf_dir))


LOCATED = f"""{HEADERS}, met AS (SELECT h.file_id, h.position, c.ord, CASE WHEN starts_with(l, {_fold("concat_ws(' ', section_number, section_name)")}) THEN 1
    WHEN starts_with(l, {_fold('section_number')}) AND contains(l, {_fold('section_name')}) THEN 2 WHEN contains(l, {_fold('section_name')}) THEN 3 END AS rule
  FROM headers h JOIN (SELECT file_id, ord, {_fold('line')} AS l FROM corpus) c ON c.file_id = h.file_id),
located AS (SELECT file_id, position, arg_min(ord, rule * 100000 + ord) AS start FROM met WHERE rule IS NOT NULL GROUP BY file_id, position),
sizes AS (SELECT file_id, max(ord) + 1 AS n FROM corpus GROUP BY file_id),
bounds AS (SELECT a.file_id, a.position, a.start, coalesce((SELECT min(b.start) FROM located b WHERE b.file_id = a.file_id AND b.position > a.position AND b.start > a.start), s.n) AS stop FROM located a JOIN sizes s USING (file_id))"""


def _bounds(spark, sf_dir):
    return headers.sections(_headers(spark, sf_dir), corpus.spec_corpus(spark, sf_dir))


@query(f"WITH {LOCATED} SELECT * FROM bounds")
def section_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir).select("file_id", "position", "start", "stop")


@query(
    f"WITH {LOCATED} SELECT b.file_id, b.position, string_agg(c.line, chr(10) ORDER BY c.ord) AS section_text FROM bounds b JOIN corpus c ON c.file_id = b.file_id AND c.ord >= b.start AND c.ord < b.stop GROUP BY b.file_id, b.position"
)
def section_text(spark, sf_dir):
    return headers.section_texts(_bounds(spark, sf_dir), corpus.spec_corpus(spark, sf_dir))


# Search: benchmark passages ask, documents answer.
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_%°.]+')"
BM25 = f"""d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS doc_len FROM d), g AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
lexical AS (SELECT query_id, tf.doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))) AS bm25
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN g GROUP BY query_id, tf.doc_id)"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN g")
def bm25_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.term_stats(docs).select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    f"WITH {BM25} SELECT query_id, doc_id, round(bm25, 6) AS bm25, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS r FROM lexical) WHERE r <= 10"
)
def bm25_search(spark, sf_dir):
    found = search.bm25_top(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 10).withColumn("bm25", F.round("bm25", 6))
    return search.top(found, "bm25", "doc_id", 10).select("query_id", "doc_id", "bm25", "rank")


def _hashed(source: str, key: str) -> str:
    byte = "(strpos('0123456789abcdef', h[i]) - 1) * 16 + strpos('0123456789abcdef', h[i + 1]) - 1"
    return (
        f"(SELECT {key}, list_transform(c, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS v FROM (SELECT {key}, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM "
        f"(SELECT {key}, list_transform(b, lambda x: x - list_sum(b) / 32.0) AS c FROM (SELECT {key}, list_transform(range(1, 65, 2), lambda i: ({byte})::DOUBLE) AS b FROM "
        f"(SELECT {key}, sha256(text) AS h FROM {source})))))"
    )


@query(f"SELECT doc_id, 384 AS n_values, round(v[1] / sqrt(12), 6) AS first, round(v[32] / sqrt(12), 6) AS last, round(list_sum(v), 6) + 0.0 AS total FROM {_hashed('documents', 'doc_id')}")
def hash_embedding(spark, sf_dir):
    v = F.col("v")
    rows = table(spark, sf_dir, "documents").select("doc_id", search.embedding(F.col("text")).alias("v"))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.size(v).alias("n_values"), F.round(v[0], 6).alias("first"), F.round(v[383], 6).alias("last"), (F.round(total, 6) + 0.0).alias("total"))


_DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"


@query(
    f"WITH {BM25}, dv AS {_hashed('documents', 'doc_id')}, qv AS {_hashed('benchmark', 'item_id')}, "
    f"near AS (SELECT b.item_id AS query_id, a.doc_id, round({_DOT}, 6) AS cosine FROM dv a CROSS JOIN qv b), "
    "dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS r FROM near) WHERE r <= 10), "
    "fused AS (SELECT query_id, doc_id, round(coalesce(bm25, 0), 6) AS bm25, coalesce(cosine, 0) AS cosine FROM lexical FULL JOIN dense USING (query_id, doc_id)), "
    "ranked AS (SELECT *, round(0.5 * bm25 + 0.5 * cosine, 6) AS score FROM fused) "
    "SELECT query_id, doc_id, bm25, cosine, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM ranked) WHERE r <= 5"
)
def hybrid_search(spark, sf_dir):
    return search.hybrid(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 5)


@query(
    "WITH u AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS v FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))), "
    f"near AS (SELECT b.vec_id AS query_id, a.vec_id AS item_id, round({_DOT}, 6) AS cosine FROM u a JOIN u b ON b.vec_id % 20 = 0) "
    "SELECT query_id, item_id, cosine, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS r FROM near) WHERE r <= 10"
)
def cosine_topk(spark, sf_dir):
    """The stated queries, vectors with an id divisible by 20, against all vectors."""
    unit = search.normalized(F.transform("embedding", lambda x: x.cast("double")))
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), unit.alias("v"))
    asked = items.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    return search.dense_top(items, asked, 10)


# Layout: the corpus drawn on pages, a page for each section.
LAYOUT = """SELECT file_id, section_no - 1 AS page_no, ord AS line_idx, line AS text, CAST(60 + 9 * (ord % 4) AS DOUBLE) AS x0, CAST(200 + 31 * (ord % 5) AS DOUBLE) AS x1,
  CAST(30 + 230 * line_idx AS DOUBLE) AS y0, CAST(792 AS DOUBLE) AS page_height, CAST(10 + 3 * ((ord * 7 + section_no) % 3) AS DOUBLE) AS font_size, ord % 3 = 0 AS is_bold, upper(line) = line AS is_caps FROM {corpus}"""


def _layout(spark, sf_dir):
    return spark.sql(LAYOUT, corpus=corpus.spec_corpus(spark, sf_dir))


TEXT_LINES = f"{CORPUS}, text_lines AS ({LAYOUT.format(corpus='corpus')})"
STATS = f"{TEXT_LINES}, stats AS (SELECT file_id, page_no, median(font_size) AS median_size, CASE WHEN stddev_pop(font_size) > 0 THEN stddev_pop(font_size) ELSE 1.0 END AS stdev, median(x0) AS indent_median FROM text_lines GROUP BY file_id, page_no)"


@query(f"WITH {STATS} SELECT file_id, page_no, median_size, round(stdev, 6) AS stdev, indent_median FROM stats")
def page_size_stats(spark, sf_dir):
    return layout.page_stats(_layout(spark, sf_dir)).withColumn("stdev", F.round("stdev", 6))


RUNNING = f"""{STATS}, span AS (SELECT file_id, max(page_no) + 1 AS pages FROM text_lines GROUP BY file_id),
short AS (SELECT *, lower(trim(text)) AS key FROM text_lines WHERE trim(text) <> '' AND length(trim(text)) <= 80 AND NOT (y0 / page_height > 0.1 AND y0 / page_height < 0.9)),
running AS (SELECT file_id, key, CAST(trunc(round(avg(y0), 1)) AS INT) AS y_at, count(DISTINCT page_no) AS seen FROM short GROUP BY file_id, key),
run AS (SELECT r.file_id, key, y_at FROM running r JOIN span s USING (file_id) WHERE seen / greatest(pages, 1) >= 0.6)"""


@query(f"WITH {RUNNING} SELECT * FROM run")
def running_lines(spark, sf_dir):
    return layout.running_lines(_layout(spark, sf_dir))


_LOW = "lower(trim(text))"
_SEG = rf"CASE WHEN regexp_matches(regexp_replace(number, '[.\-]+$', ''), '^\p{{L}}$') THEN 2 WHEN {_SEGMENTS} = 0 THEN 1 WHEN {_SEGMENTS} > 1 AND regexp_matches(number, '^\p{{L}}\.') THEN {_SEGMENTS} + 1 ELSE {_SEGMENTS} END"
SCORED = rf"""{RUNNING}, contents AS (SELECT file_id, page_no FROM (SELECT file_id, page_no, sum(CASE WHEN regexp_matches({_LOW}, '\.{{3,}}\s*\d+$') THEN 2 ELSE 0 END + CASE WHEN regexp_matches({_LOW}, 'contents|toc') THEN 4 ELSE 0 END) AS s FROM text_lines GROUP BY ALL) WHERE s >= 4),
body AS (SELECT *, trim(text) AS t FROM text_lines l WHERE NOT EXISTS (SELECT 1 FROM contents c WHERE c.file_id = l.file_id AND c.page_no = l.page_no)
  AND NOT EXISTS (SELECT 1 FROM run r WHERE r.file_id = l.file_id AND r.key = {_LOW} AND r.y_at = CAST(trunc(round(y0, 1)) AS INT))
  AND trim(text) <> '' AND NOT (starts_with(lower(text), 'table ') OR starts_with(lower(text), 'figure ')
    OR (length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) > length(regexp_replace(text, '\P{{L}}', '', 'g')) AND length(regexp_replace(text, '\P{{L}}', '', 'g')) >= 1))),
parts AS (SELECT *, {_N} AS number, {_T} AS title FROM body),
parted AS (SELECT p.*, s.median_size, s.stdev, s.indent_median - x0 AS delta, coalesce(number, '') <> '' AS has FROM parts p JOIN stats s USING (file_id, page_no)),
scored AS (SELECT file_id, page_no, line_idx, number, title, font_size, greatest(0.0, round(0.45 * greatest(0.0, (font_size - median_size) / greatest(stdev, 1.0)) + CASE WHEN is_bold THEN 0.25 ELSE 0.0 END + CASE WHEN is_caps THEN 0.09 ELSE 0.0 END
  + 0.25 * CASE WHEN has THEN 0.9 + 0.1 * greatest({_SEG} - 1, 0) ELSE 0.0 END
  + 0.15 * CASE WHEN delta > 12 THEN 0.6 WHEN delta > 6 THEN 0.3 WHEN delta > 2 THEN 0.1 WHEN has AND delta < -12 THEN 0.2 WHEN has AND delta < -6 THEN 0.1 ELSE 0.0 END
  - CASE WHEN length(text) > 120 THEN 0.4 WHEN length(text) > 80 THEN 0.2 ELSE 0.0 END, 6)) AS score FROM parted)"""


@query(f"WITH {SCORED} SELECT file_id, page_no, line_idx, number, title, CAST(score AS DOUBLE) AS score FROM scored")
def header_score(spark, sf_dir):
    return layout.scored(_layout(spark, sf_dir)).select("file_id", "page_no", "line_idx", "number", "title", "score")


@query()
def layout_headers(spark, sf_dir):
    """Detected headers with levels and ids, as a tree."""
    found = layout.with_levels(layout.detected(_layout(spark, sf_dir)))
    placed = found.withColumn("position", F.row_number().over(W.partitionBy("file_id").orderBy("page_no", "line_idx")))
    named = placed.select("file_id", "page_no", "line_idx", "position", "level", F.coalesce("number", F.lit("")).alias("section_number"), F.col("title").alias("section_name"), "score")
    return headers.section_tree(named).withColumn("id", identity.header_id(F.col("page_no"), F.col("line_idx"), F.col("section_name")))


@query(
    f"WITH {TEXT_LINES}, x AS (SELECT file_id, page_no, list(x0 ORDER BY x0) AS x FROM text_lines GROUP BY ALL), g AS (SELECT *, x[len(x) // 2 + 1] - x[len(x) // 2] AS gap0 FROM x) "
    "SELECT file_id, page_no, CASE WHEN len(x) < 4 THEN 1 WHEN gap0 > 70 THEN 2 ELSE 1 END AS columns, CASE WHEN len(x) < 4 THEN 0.0::DOUBLE ELSE round(gap0, 2) END AS gap FROM g"
)
def column_gap(spark, sf_dir):
    return layout.columns_by_gap(_layout(spark, sf_dir))


@query()
def column_kmeans(spark, sf_dir):
    return layout.assigned_columns(_layout(spark, sf_dir))


# Pages as a parser nests them: each corpus line is a block of two spans, every seventh block is of another kind.
NESTED = """SELECT file_id, CAST(section_no - 1 AS INT) AS page_no, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height, transform(array_sort(collect_list(struct(ord, line_idx, line))),
  x -> named_struct('type', CASE WHEN x.ord % 7 = 6 THEN 2 ELSE CAST(x.ord % 2 AS INT) END, 'bbox', CAST(NULL AS ARRAY<DOUBLE>), 'lines', array(
    named_struct('bbox', array(CAST(60 + 9 * (x.ord % 4) AS DOUBLE), CAST(730 - 230 * x.line_idx AS DOUBLE), CAST(200 AS DOUBLE), CAST(740 AS DOUBLE)), 'spans', array(
      named_struct('text', concat(' ', substring(x.line, 1, 6)), 'font', CASE WHEN x.ord % 3 > 0 THEN 'Serif' END, 'size', CAST(10 + x.ord % 3 AS DOUBLE), 'flags', CAST(x.ord % 4 AS INT)),
      named_struct('text', concat(substring(x.line, 7), ' '), 'font', CASE WHEN x.ord % 5 = 0 THEN 'Serif-Bold' ELSE 'Sans' END, 'size', CAST(12 AS DOUBLE), 'flags', 4)))))) AS blocks
FROM {corpus} GROUP BY file_id, section_no"""


@query(
    f"""WITH {CORPUS}, kept AS (SELECT *, {_RAW} AS text FROM corpus WHERE ord % 7 <> 6 AND {_RAW} <> '')
SELECT file_id, text, CAST(60 + 9 * (ord % 4) AS DOUBLE) AS x0, CASE WHEN ord % 3 > 0 THEN 'Serif' WHEN ord % 5 = 0 THEN 'Serif-Bold' ELSE 'Sans' END AS font_family, (22 + ord % 3) / 2.0::DOUBLE AS font_size,
  ord % 4 >= 2 OR ord % 5 = 0 AS is_bold, regexp_matches(text, '\\p{{L}}') AND NOT regexp_matches(text, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AS is_caps, CAST(section_no - 1 AS INT) AS page_no,
  CAST(row_number() OVER (PARTITION BY file_id ORDER BY section_no, line_idx DESC) - 1 AS INT) AS line_idx, CASE WHEN ord % 3 > 0 THEN 2 ELSE 1 END AS n_fonts, CAST((ord % 4) | 4 AS INT) AS flags FROM kept"""
)
def page_text_lines(spark, sf_dir):
    """Lines from nested pages, in reading order, with the fonts that their spans tell."""
    pages = spark.sql(NESTED, corpus=corpus.spec_corpus(spark, sf_dir))
    return page_lines.text_lines(pages, multi_column=False).select(
        "file_id", "text", F.col("bbox")[0].alias("x0"), "font_family", "font_size", "is_bold", "is_caps", "page_no", "line_idx", F.size("span_fonts").alias("n_fonts"), "flags"
    )


@query(
    f"""WITH RECURSIVE {TREE}, l AS (SELECT *, 1 + (ord * 3 + position) % 5 AS said FROM tree0),
deep AS (SELECT file_id, position, parent, greatest(1, said) AS depth FROM l WHERE parent IS NULL
  UNION ALL SELECT l.file_id, l.position, l.parent, greatest(d.depth + 1, l.said) FROM l JOIN deep d ON d.file_id = l.file_id AND d.position = l.parent),
ids AS (SELECT file_id, position, concat(file_id, '-sec-', CASE WHEN position < 10000 THEN lpad(CAST(position AS VARCHAR), 4, '0') ELSE CAST(position AS VARCHAR) END) AS id FROM l)
SELECT d.file_id, i.id AS section_id, coalesce(p.id, concat(d.file_id, '-root')) AS parent_section, d.position, CAST(d.depth AS INT) AS depth
FROM deep d JOIN ids i USING (file_id, position) LEFT JOIN ids p ON p.file_id = d.file_id AND p.position = d.parent"""
)
def section_nodes(spark, sf_dir):
    """The section tree of header nodes whose levels skip and repeat: each is one below its parent at least."""
    nodes = _tree(spark, sf_dir).select(
        "file_id", "position", "parent", (1 + (F.col("ord") * 3 + F.col("position")) % 5).cast("int").alias("level"), F.col("section_number").alias("number"), F.col("section_name").alias("title")
    )
    return headers.section_nodes(nodes).select("file_id", "section_id", "parent_section", "position", "depth")


# Reports and exports.
_QA = f"""{ATOMS}, leaves AS (SELECT DISTINCT file_id, section_id FROM corpus), objs AS (SELECT file_id, count(*) AS parsed_object_count FROM corpus GROUP BY file_id),
made AS (SELECT file_id, count(*) AS specs_count FROM atoms GROUP BY file_id), withs AS (SELECT l.file_id, count(*) AS leaf_section_count, count(a.section_id) AS n FROM leaves l LEFT JOIN (SELECT DISTINCT file_id, section_id FROM atoms) a USING (file_id, section_id) GROUP BY l.file_id)"""


@query(f"WITH {_QA} SELECT o.file_id, parsed_object_count, leaf_section_count, coalesce(specs_count, 0) AS specs_count, round(n / leaf_section_count, 6) AS leaf_spec_ratio FROM objs o JOIN withs USING (file_id) LEFT JOIN made USING (file_id)")
def qa_coverage(spark, sf_dir):
    rows = corpus.spec_corpus(spark, sf_dir)
    return quality.coverage(rows, rows.select("file_id", "section_id").distinct(), atomize.atomize(rows))


@query(
    f"WITH {ATOMS}, twice AS (SELECT file_id, spec_id FROM atoms GROUP BY ALL HAVING count(*) > 1), dup AS (SELECT file_id, count(*) AS n, string_agg(spec_id, ', ' ORDER BY spec_id) AS ids FROM twice GROUP BY file_id), "
    "bad AS (SELECT file_id, string_agg(spec_id, ', ' ORDER BY spec_id) AS ids, count(*) AS n FROM atoms WHERE section_id = 'sec-1' GROUP BY file_id), files AS (SELECT DISTINCT file_id FROM atoms) "
    "SELECT f.file_id, CAST(coalesce(b.n, 0) AS INT) AS mismatched, CAST(coalesce(d.n, 0) AS INT) AS duplicates, concat_ws(chr(10), 'Source-object mismatch for spec_ids: ' || b.ids, 'Duplicate spec_ids detected: ' || d.ids) AS warnings "
    "FROM files f LEFT JOIN bad b USING (file_id) LEFT JOIN dup d USING (file_id)"
)
def qa_consistency(spark, sf_dir):
    """Specs whose sources are their section's objects, except that those of first sections have lost them."""
    rows = corpus.spec_corpus(spark, sf_dir)
    chunks = atomize.section_sources(rows).withColumnRenamed("source_object_ids", "object_ids")
    made = atomize.atomize(rows).join(chunks, ["file_id", "section_id"]).withColumn(
        "source_object_ids", F.when(F.col("section_id") != "sec-1", F.col("object_ids"))
    )
    return quality.consistency(made.drop("object_ids"), chunks)


def _specs(spark, sf_dir):
    made = atomize.atomize(atomize.with_sources(corpus.spec_corpus(spark, sf_dir)), "source_object_ids")
    number = F.regexp_extract("section_id", r"\d+", 0)
    return made.select("file_id", "section_id", "spec_id", *made.columns[3:], number.alias("section_number"), F.concat(F.lit("Section "), number).alias("section_title"))


def _export(ids: str, confidence: str) -> str:
    return (
        f"WITH {ATOMS}, {_SOURCES} SELECT spec_id, file_id, section_id, regexp_extract(section_id, '\\d+') AS section_number, concat('Section ', regexp_extract(section_id, '\\d+')) AS section_title, "
        f"spec_text, {confidence} AS confidence, {ids} AS source_object_ids FROM atoms JOIN sources USING (file_id, section_id)"
    )


@query(_export("'[\"' || replace(ids, ',', '\",\"') || '\"]'", "CAST(confidence AS VARCHAR)"))
def export_csv_a(spark, sf_dir):
    return export.csv_rows(_specs(spark, sf_dir))


@query(_export("ids", "CAST(confidence AS VARCHAR)"))
def export_csv_b(spark, sf_dir):
    return export.csv_rows(_specs(spark, sf_dir), ",")


_ITEM = "concat('{\"spec_id\":\"', spec_id, '\",\"file_id\":\"', file_id, '\",\"section_id\":\"', section_id, '\",\"section_number\":\"', section_number, '\",\"section_title\":\"', section_title, '\",\"spec_text\":\"', spec_text, '\",\"confidence\":', confidence, ',\"source_object_ids\":', source_object_ids, '}')"
_LISTED = _export("'[\"' || replace(ids, ',', '\",\"') || '\"]'", "CAST(confidence AS VARCHAR)")


@query(f"SELECT file_id, concat('{{\"file_id\":\"', file_id, '\",\"specs\":[', string_agg({_ITEM}, ',' ORDER BY section_title, spec_id), ']}}') AS payload FROM ({_LISTED}) GROUP BY file_id")
def export_json(spark, sf_dir):
    return export.json_payloads(_specs(spark, sf_dir))


_WHOLE = (
    "concat('{\"file_id\":\"', file_id, '\",\"section_id\":\"', section_id, '\",\"spec_id\":\"', spec_id, '\",\"spec_text\":\"', spec_text, '\"', ',\"raw_value\":\"' || raw_value || '\"', ',\"normalized_value\":' || CAST(normalized_value AS VARCHAR), "
    "',\"normalized_unit\":\"' || normalized_unit || '\"', ',\"category\":\"', category, '\",\"confidence\":', confidence, ',\"source_object_ids\":[\"', replace(ids, ',', '\",\"'), '\"],\"section_number\":\"', "
    "regexp_extract(section_id, '\\d+'), '\",\"section_title\":\"Section ', regexp_extract(section_id, '\\d+'), '\"}')"
)


@query(f"WITH {ATOMS}, {_SOURCES} SELECT file_id, sha256(concat('[', string_agg({_WHOLE}, ',' ORDER BY spec_id), ']')) AS sha256 FROM atoms JOIN sources USING (file_id, section_id) GROUP BY file_id")
def qa_determinism(spark, sf_dir):
    return quality.fingerprints(_specs(spark, sf_dir), "spec_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100")
def paginate(spark, sf_dir):
    """The third page of fifty: the limit is the feature."""
    return lines.paginated(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 3, 50)


@query(
    f"WITH {CORPUS}, l AS (SELECT DISTINCT line FROM corpus), k AS (SELECT line, list_aggregate(list_transform(regexp_extract_all(line, '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 20, '0') ELSE lower(x) END), 'string_agg', '') AS key FROM l) "
    "SELECT line, CAST(row_number() OVER (ORDER BY key, line) AS INT) AS place FROM k"
)
def natural_sort(spark, sf_dir):
    """Lines in natural order, with their places: ranks by range partitions, not in one task."""
    return sequences.placed(corpus.spec_corpus(spark, sf_dir).select("line").distinct().withColumn("key", text.natural_key(F.col("line"))), ["key", "line"]).select("line", "place")


@query(f"WITH {ATOMS} SELECT * FROM atoms WHERE contains(lower(concat_ws(' ', section_id, spec_text, category, normalized_unit)), 'vdc')")
def row_filter(spark, sf_dir):
    return lines.filtered(spec_atomize(spark, sf_dir), "VDC", ["section_id", "spec_text", "category", "normalized_unit"])


OBJECTS = """SELECT file_id, concat(file_id, '-txt-', lpad(CAST(ord AS STRING), 6, '0')) AS object_id, CAST(section_no - 1 AS INT) AS page_index, 3 * line_idx + 5 AS order_index,
  CASE WHEN ord % 11 = 0 THEN 'figure' WHEN ord % 13 = 0 THEN 'table' WHEN ord % 2 = 0 THEN 'line' ELSE 'para' END AS kind, CASE WHEN ord % 11 <> 0 THEN line END AS text FROM {corpus}"""
OBJS = f"{CORPUS}, objects AS ({OBJECTS.format(corpus='corpus')})"


def _objects(spark, sf_dir):
    return spark.sql(OBJECTS, corpus=corpus.spec_corpus(spark, sf_dir))


@query(
    f"WITH {OBJS}, s AS (SELECT file_id, sum(CASE WHEN kind IN ('line', 'para') THEN length(coalesce(text, '')) ELSE 0 END)::BIGINT AS text_chars, bool_or(kind = 'figure') AS has_images, bool_or(kind = 'table') AS has_tables FROM objects GROUP BY file_id) "
    "SELECT *, CASE WHEN (text_chars < 200 AND has_images) OR (NOT has_tables AND has_images) THEN 'layout' ELSE 'native' END AS engine FROM s"
)
def engine_choice(spark, sf_dir):
    return quality.engine_choice(_objects(spark, sf_dir))


@query(f"WITH {OBJS} SELECT object_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY coalesce(page_index, 0), order_index, object_id) - 1 AS INT) AS order_index FROM objects")
def objects_renumber(spark, sf_dir):
    return lines.renumbered(_objects(spark, sf_dir)).select("object_id", "order_index")


@query(f"WITH {OBJS} SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY coalesce(page_index, 0), order_index) - 1 AS INT) AS line_no, text AS entry FROM objects WHERE kind <> 'figure'")
def object_lines(spark, sf_dir):
    made = _objects(spark, sf_dir).withColumn("line_index", F.lit(None).cast("int"))
    return lines.object_lines(made).select("file_id", "line_no", "entry")


# Events as progress.
_STATE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"


@query(f"SELECT user_id, max({_STATE}) AS stage, bool_or(event_type = 'error') AS failed, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def progress_state(spark, sf_dir):
    from ..streaming import progress

    return progress.states(table(spark, sf_dir, "events"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from ..streaming import progress

    return progress.windowed(table(spark, sf_dir, "events"), "1 hour")


# A model's answers for each section: its lines as a fenced list, now and then NONE, or no list at all.
def _answers(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("ord", "line")))
    said = F.array_join(F.transform(rows, lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    turn = F.col("section_no") + F.substring("file_id", 7, 20).cast("int")
    return corpus.spec_corpus(spark, sf_dir).groupBy("file_id", "section_no").agg(said.alias("said")).select(
        "file_id", F.col("section_no").alias("position"), F.col("section_no").cast("string").alias("section_number"), F.concat(F.lit("Section "), "section_no").alias("section_name"),
        F.when(turn % 13 == 0, "No list.").when(turn % 7 == 0, "#specs#\nnone\n#specs#").otherwise(F.concat(F.lit("So:\n#specs#\n"), "said", F.lit("\n#SPECS# done"))).alias("response"),
    )


ANSWERS = f"""{CORPUS}, answers AS (SELECT file_id, section_no AS position, (section_no + CAST(substr(file_id, 7) AS INT)) % 13 <> 0 AS good,
  CASE WHEN (section_no + CAST(substr(file_id, 7) AS INT)) % 7 <> 0 THEN list(line ORDER BY ord) ELSE [] END AS specs FROM (SELECT file_id, section_no, ord, {_RAW} AS line FROM corpus) GROUP BY file_id, section_no),
ended AS (SELECT *, min(CASE WHEN NOT good THEN position END) OVER (PARTITION BY file_id) AS failed FROM answers),
told AS (SELECT * FROM ended WHERE failed IS NULL OR position <= failed),
answer_events AS (SELECT file_id, (position * 3 + step)::BIGINT AS seq, CASE step WHEN 0 THEN 'request' WHEN 1 THEN 'response' ELSE CASE WHEN good THEN 'processed' ELSE 'error' END END AS event,
    CASE WHEN step < 2 OR good THEN CAST(position AS VARCHAR) END AS section_number, CASE WHEN step = 2 AND good THEN specs END AS specs,
    CASE WHEN step = 2 AND NOT good THEN concat('LLM returned unexpected format for section ', position) END AS message FROM told CROSS JOIN (SELECT unnest([0, 1, 2]) AS step)
  UNION ALL SELECT file_id, ((max(position) + 1) * 3)::BIGINT, 'complete', NULL, flatten(list(specs ORDER BY position)), NULL FROM told WHERE failed IS NULL GROUP BY file_id)"""


@query(f"WITH {ANSWERS} SELECT file_id, seq, event, section_number, len(specs)::INT AS n_specs, array_to_string(specs, '|') AS specs, message FROM answer_events")
def answer_events(spark, sf_dir):
    """The events of a model's answers; the first answer without a list ends its document."""
    from ..streaming import answers

    texts = F.array_join(F.transform("specs", lambda x: x["spec_text"]), "|")
    found = answers.events_of(_answers(spark, sf_dir))
    return found.select("file_id", "seq", "event", "section_number", F.when(F.col("specs").isNotNull(), F.size("specs")).alias("n_specs"), texts.alias("specs"), "message")


@query(
    f"""WITH {ANSWERS}, ends AS (SELECT file_id, event, specs FROM answer_events WHERE event IN ('complete', 'error')),
counts AS (SELECT file_id, count(*) * 2 AS n_events, count(*) FILTER (event = 'request') AS requested, count(*) FILTER (event = 'processed') AS processed, flatten(list(specs ORDER BY seq) FILTER (event = 'processed')) AS gathered, any_value(message) AS message FROM answer_events GROUP BY file_id)
SELECT file_id, CASE event WHEN 'complete' THEN 'complete' ELSE 'failed' END AS state, message, requested, processed, n_events, array_to_string(coalesce(specs, gathered, []), '|') AS specs FROM counts JOIN ends USING (file_id)"""
)
def answers_known(spark, sf_dir):
    """What a reader of the events, each told twice, knows of every document."""
    from ..streaming import answers

    events = answers.events_of(_answers(spark, sf_dir))
    return answers.known(events.unionByName(events)).select("file_id", "state", "message", "requested", "processed", "n_events", F.array_join("specs", "|").alias("specs"))


_KEY = "lower(trim(regexp_replace({0}, '[^0-9A-Za-z]+', ' ', 'g')))"


@query(
    f"""WITH RECURSIVE {HEADERS}, keyed AS (SELECT file_id, ord, {_KEY.format('line')} AS l FROM corpus), heads AS (SELECT file_id, position, {_KEY.format('section_name')} AS t FROM headers),
walk AS (SELECT DISTINCT file_id, 0::INT AS position, 0::INT AS next, NULL::INT AS anchor FROM heads
  UNION ALL SELECT file_id, position, coalesce(met + 1, next)::INT, met::INT FROM (SELECT w.file_id, h.position, w.next, min(k.ord) AS met FROM walk w JOIN heads h ON h.file_id = w.file_id AND h.position = w.position + 1
    LEFT JOIN keyed k ON k.file_id = w.file_id AND k.ord >= w.next AND k.l <> '' AND h.t <> '' AND (starts_with(k.l, h.t) OR starts_with(h.t, k.l)) GROUP BY w.file_id, h.position, w.next))
SELECT file_id, position, anchor FROM walk WHERE position > 0"""
)
def anchor_monotone(spark, sf_dir):
    """Titles of rule headers anchored in document order."""
    return sequences.anchored(_headers(spark, sf_dir), corpus.spec_corpus(spark, sf_dir))


_BARE = "regexp_replace(regexp_replace(token, '^[()]+|[()]+$', '', 'g'), '[.]+$', '')"
NESTED_LIST = f"""{HEADERS}, said AS (SELECT file_id, position, trim(concat_ws(' ', section_number, section_name)) AS l FROM headers),
tokens AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY position) - 1 AS INT) AS place, l, split_part(l, ' ', 1) AS token, trim(substr(l, length(split_part(l, ' ', 1)) + 2)) AS rest FROM said),
listed AS (SELECT *, rest <> '' AND regexp_matches(replace({_BARE}, '.', ''), '^[\\p{{L}}\\p{{N}}]+$') AS is_listed FROM tokens),
items AS (SELECT file_id, place, CASE WHEN is_listed THEN length(regexp_replace(token, '[.)]+$', '')) - length(replace(regexp_replace(token, '[.)]+$', ''), '.', '')) ELSE 0 END AS depth,
  CASE WHEN is_listed THEN token ELSE '' END AS number, CASE WHEN is_listed THEN rest ELSE l END AS title FROM listed)"""


@query(f"WITH {NESTED_LIST} SELECT file_id, place AS \"at\", CAST(depth AS INT) AS depth, number, title FROM items")
def nested_list_parse(spark, sf_dir):
    return sequences.nested(headers.header_block(_headers(spark, sf_dir)))


@query()
def fuzzy_match(spark, sf_dir):
    """Each header's closest line by matching blocks."""
    return sequences.closest(_headers(spark, sf_dir), corpus.spec_corpus(spark, sf_dir))


def misread(c):
    """Text as a bad reading has it: other vowels, a letter dropped."""
    return F.regexp_replace(F.translate(c, "eEoO", "cC0Q"), "[rR]([a-zA-Z])", "$1")


@query()
def section_bounds_by_likeness(spark, sf_dir):
    """Bounds of headers that were misread at every other position: those that no line has begin at the line most alike."""
    rows = corpus.spec_corpus(spark, sf_dir)
    read = _headers(spark, sf_dir).withColumn("section_name", F.when(F.col("position") % 2 == 0, misread(F.col("section_name"))).otherwise(F.col("section_name")))
    return headers.sections(read, rows, alike=True).select("file_id", "position", "start", "stop")


@query()
def marker_expansion(spark, sf_dir):
    return matching.line_variants(corpus.spec_corpus(spark, sf_dir)).select("line", F.array_join("variants", " | ").alias("variants"))


@query()
def verified_headers(spark, sf_dir):
    """Headers held against their documents, with evidence; multi-word titles by whole lines too."""
    rows = corpus.spec_corpus(spark, sf_dir)
    return matching.verified(_headers(spark, sf_dir), lines.joined(rows, "file_id", "ord", "line"), strict=False)


@query()
def clean_documents(spark, sf_dir):
    return matching.cleaned(lines.joined(corpus.spec_corpus(spark, sf_dir), "file_id", "ord", "line"))


@query(
    f"""WITH {NESTED_LIST}, stepped AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY place) - 1 AS k FROM items), least0 AS (SELECT *, min(depth - k) OVER (PARTITION BY file_id ORDER BY place) AS low FROM stepped)
SELECT file_id, place AS "at", number, title, concat(file_id, '-sec-', lpad(CAST(k + 1 AS VARCHAR), 4, '0')) AS section_id, CAST(least(low, 0) + k AS INT) AS depth FROM least0"""
)
def outline_tree(spark, sf_dir):
    return matching.outline(nested_list_parse(spark, sf_dir))


@query(
    f"WITH {HEADERS} SELECT file_id, position, section_number, CASE WHEN contains(section_number, '.') THEN regexp_replace(section_number, '\\.[^.]*$', '') END AS parent_number FROM headers"
)
def dotted_tree(spark, sf_dir):
    return matching.by_dotted_number(_headers(spark, sf_dir)).select("file_id", "position", "section_number", "parent_number")


@query(
    f"WITH {LOCATED}, numbered AS (SELECT l.*, h.section_number FROM located l JOIN headers h USING (file_id, position)) SELECT a.file_id, a.position, a.start, "
    "coalesce((SELECT min(b.start) FROM numbered b WHERE b.file_id = a.file_id AND b.section_number <> a.section_number AND b.start > a.start), s.n) AS stop FROM numbered a JOIN sizes s USING (file_id)"
)
def sections_closed_by_others(spark, sf_dir):
    found = headers.located(_headers(spark, sf_dir), corpus.spec_corpus(spark, sf_dir))
    return matching.closed_by_others(found).select("file_id", "position", "start", "stop")


@query(
    f"WITH {LOCATED} SELECT l.file_id, l.position, c.section_no AS page_number, CAST(c.line_idx + 1 AS INT) AS line_number FROM located l JOIN corpus c ON c.file_id = l.file_id AND c.ord = l.start"
)
def header_locations(spark, sf_dir):
    rows = corpus.spec_corpus(spark, sf_dir).withColumn("page", F.col("section_no") - 1)
    found = headers.sections(_headers(spark, sf_dir), rows, "page", "line_idx")
    return found.select("file_id", "position", (F.col("page") + 1).alias("page_number"), (F.coalesce("line_idx", "start") + 1).cast("int").alias("line_number"))


_TITLE = _NORMAL.replace("line", "section_name")


@query(
    f"""WITH RECURSIVE {TREE}, leaves AS (SELECT file_id, position, section_name, CASE WHEN position % 2 = 1 THEN ord END AS start FROM tree0 WHERE last = position),
heads AS (SELECT l.file_id, l.position, min(c.ord) AS found FROM (SELECT *, lower({_TITLE}) AS t FROM leaves WHERE start IS NULL) l JOIN (SELECT file_id, ord, lower({_NORMAL}) AS t FROM corpus) c ON c.file_id = l.file_id AND c.t = l.t WHERE l.t <> '' GROUP BY ALL),
starts AS (SELECT l.file_id, l.position, coalesce(start, found) AS first, start IS NULL AS bare FROM leaves l LEFT JOIN heads h USING (file_id, position) WHERE coalesce(start, found) IS NOT NULL),
ends AS (SELECT file_id, max(ord) AS n FROM corpus GROUP BY file_id)
SELECT s.file_id, s.position, s.first, greatest(coalesce((SELECT min(x.first) FROM starts x WHERE x.file_id = s.file_id AND x.first > s.first) - 1, n), s.first) AS last FROM starts s JOIN ends USING (file_id) WHERE bare"""
)
def leaf_fallback_ranges(spark, sf_dir):
    """Leaves of the section tree; those at even positions have lost their chunks."""
    leaves = _tree(spark, sf_dir).where("last = position").select("file_id", "position", "section_name", F.when(F.col("position") % 2 == 1, F.col("ord")).alias("start"))
    return matching.fallback_ranges(leaves, corpus.spec_corpus(spark, sf_dir))


# Documents put together again.
@query(f"WITH {CORPUS} SELECT file_id, section_id, count(*) AS n_objects, string_agg(line, chr(10) ORDER BY ord DESC) AS text FROM corpus WHERE ord % 9 <> 4 GROUP BY file_id, section_id")
def chunk_texts(spark, sf_dir):
    """Chunks with their objects' texts, in the chunks' own order, here from the last on; objects that are missing are skipped."""
    rows = corpus.spec_corpus(spark, sf_dir)
    name = identity.numbered(F.col("file_id"), "txt", F.col("ord"))
    chunks = atomize.section_sources(rows).withColumn("object_ids", F.reverse("source_object_ids"))
    return documents.chunk_texts(chunks, rows.where("ord % 9 <> 4").select("file_id", name.alias("object_id"), F.col("line").alias("text")))


@query(
    f"WITH {OBJS} SELECT object_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY CASE kind WHEN 'table' THEN 1 WHEN 'figure' THEN 2 ELSE 0 END, page_index, order_index, object_id) - 1 AS INT) AS order_index FROM objects"
)
def objects_in_one_order(spark, sf_dir):
    made = _objects(spark, sf_dir)
    kinds = (made.where("kind in ('line', 'para')"), made.where("kind = 'table'"), made.where("kind = 'figure'"))
    return documents.in_one_order(*kinds).select("object_id", "order_index")


@query(f"WITH {ATOMS} SELECT section_id AS section_number, '' AS section_name, coalesce(spec_text, '') AS specification, category AS domain FROM atoms")
def renamed_specs(spark, sf_dir):
    """Specs under the names that a table of them shows, from whichever names their columns have."""
    made = spec_atomize(spark, sf_dir).withColumnRenamed("section_id", "section")
    return documents.renamed(made)


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars, doc_id LIMIT 40 OFFSET 40")
def paginate_with_total(spark, sf_dir):
    """The second page of forty and the number of all rows: the limit is the feature."""
    return documents.page_with_total(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 2, 40)


@query(
    f"WITH RECURSIVE {TREE} SELECT t.file_id, CAST(t.position AS INT) AS place, t.section_number, t.section_name, c.section_no AS page_number, c.line_idx AS line_number, t.section_name AS chunk_text FROM tree0 t JOIN corpus c ON c.file_id = t.file_id AND c.ord = t.ord"
)
def flat_headers(spark, sf_dir):
    rows = corpus.spec_corpus(spark, sf_dir).withColumn("page", F.col("section_no") - 1)
    tree = headers.section_tree(headers.leveled(headers.rule_headers(rows, "page", "line_idx")))
    return documents.flat_headers(tree.withColumnRenamed("line_idx", "line"))


_NATURAL = "list_aggregate(list_transform(regexp_extract_all({0}, '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 20, '0') ELSE lower(x) END), 'string_agg', '')"


@query(
    f"WITH {HEADERS}, p AS (SELECT *, CASE WHEN contains(section_number, '.') THEN regexp_replace(section_number, '\\.[^.]*$', '') END AS parent_number FROM headers) "
    f"SELECT file_id, position, parent_number, CAST(row_number() OVER (PARTITION BY file_id, parent_number ORDER BY {_NATURAL.format('section_number')}, position) AS INT) AS child_place FROM p"
)
def children_in_order(spark, sf_dir):
    return documents.children_in_order(matching.by_dotted_number(_headers(spark, sf_dir))).select("file_id", "position", "parent_number", "child_place")


@query(
    f"""WITH {HEADERS}, {PAGES.removeprefix(CORPUS + ", ")},
real0 AS (SELECT file_id, page, line_idx, line FROM pages0 ANTI JOIN toc_pages USING (file_id, page) WHERE NOT entry),
kept AS (SELECT * FROM real0 UNION ALL SELECT file_id, page, line_idx, line FROM pages0 ANTI JOIN real0 USING (file_id)),
body AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY page, line_idx) - 1 AS INT) AS ord FROM kept),
met AS (SELECT h.file_id, h.position, c.ord, CASE WHEN starts_with(l, {_fold("concat_ws(' ', section_number, section_name)")}) THEN 1
    WHEN starts_with(l, {_fold('section_number')}) AND contains(l, {_fold('section_name')}) THEN 2 WHEN contains(l, {_fold('section_name')}) THEN 3 END AS rule
  FROM headers h JOIN (SELECT file_id, ord, {_fold('line')} AS l FROM body) c ON c.file_id = h.file_id),
located AS (SELECT file_id, position, arg_min(ord, rule * 100000 + ord) AS start FROM met WHERE rule IS NOT NULL GROUP BY file_id, position),
sizes AS (SELECT file_id, max(ord) + 1 AS n FROM body GROUP BY file_id),
bounds AS (SELECT a.file_id, a.position, a.start, coalesce((SELECT min(b.start) FROM located b WHERE b.file_id = a.file_id AND b.position > a.position AND b.start > a.start), s.n) AS stop FROM located a JOIN sizes s USING (file_id)),
texts AS (SELECT b.file_id, b.position, string_agg(c.line, chr(10) ORDER BY c.ord) AS t FROM bounds b JOIN body c ON c.file_id = b.file_id AND c.ord >= b.start AND c.ord < b.stop GROUP BY ALL)
SELECT h.file_id, h.position, c.page + 1 AS page_number, CAST(c.line_idx + 1 AS INT) AS line_number, coalesce(nullif({_strip('t')}, ''), trim(concat_ws(' ', section_number, section_name))) AS chunk_text
FROM headers h LEFT JOIN bounds b USING (file_id, position) LEFT JOIN body c ON c.file_id = b.file_id AND c.ord = b.start LEFT JOIN texts x ON x.file_id = h.file_id AND x.position = h.position"""
)
def header_records(spark, sf_dir):
    """Headers with the page, the line and the text of their sections, contents left out."""
    rows = corpus.spec_corpus(spark, sf_dir).withColumn("page", F.col("section_no") - 1)
    return documents.header_records(_headers(spark, sf_dir), rows, likeness=False).withColumn("line_number", F.col("line_number").cast("int"))


@query(
    f"""WITH {CORPUS}, w AS (SELECT file_id, section_no - 1 AS page_no, line_idx AS block, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS pos FROM corpus)
SELECT file_id, page_no, CAST(row_number() OVER (PARTITION BY file_id, page_no ORDER BY min(400 - 90 * block + pos % 3), min(pos)) - 1 AS INT) AS line_no, trim(string_agg(text, ' ' ORDER BY pos)) AS text,
  min(40 * pos) / 2.0::DOUBLE AS x0, max(40 * pos + 30) / 2.0::DOUBLE AS x1, (max(18 + pos % 5)) / 2.0::DOUBLE AS font_size, regexp_matches(trim(string_agg(text, ' ' ORDER BY pos)), '\\p{{L}}') AND upper(trim(string_agg(text, ' ' ORDER BY pos))) = trim(string_agg(text, ' ' ORDER BY pos)) AS is_caps
FROM w WHERE trim(text) <> '' GROUP BY file_id, page_no, block"""
)
def recognized_lines(spark, sf_dir):
    """Lines from recognized words, twice as large in pixels as in points."""
    words = corpus.spec_corpus(spark, sf_dir).select("file_id", (F.col("section_no") - 1).alias("page_no"), F.col("line_idx").alias("block"), F.lit(1).alias("line"), F.posexplode(F.split("line", " ")).alias("at", "text"))
    placed = words.withColumns({"left": 40 * F.col("at"), "top": 400 - 90 * F.col("block") + F.col("at") % 3, "width": F.lit(30), "height": 18 + F.col("at") % 5})
    found = documents.recognized_lines(placed, F.lit(0.5), F.lit(0.5))
    return found.select("file_id", "page_no", "line_no", "text", F.col("bbox")[0].alias("x0"), F.col("bbox")[2].alias("x1"), "font_size", "is_caps")
