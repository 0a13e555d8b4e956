"""Registered queries of readers, casts and small functions: over the tables' own texts, or over what Spark makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import corpus, documents, headers, quality
from ..sources import files, sinks, tolerant
from ..streaming import progress
from . import sequences
from .catalog import _LISTED, _RAW, CORPUS, HEADERS, OBJS, _fold, _headers, _objects, _specs, _strip, query, table


def _files(spark, sf_dir) -> DataFrame:
    """The documents' texts as files; every fourth in another encoding."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc-"), "doc_id").alias("file_id"), F.encode("text", "utf-8").alias("content"))


LINES = """raw AS (SELECT concat('doc-', doc_id) AS file_id, string_split(text, chr(10)) AS l FROM documents), cut AS (SELECT file_id, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM raw),
lines AS (SELECT file_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_index FROM cut)"""


@query(f"WITH {LINES} SELECT concat(file_id, '-txt-', lpad(CAST(line_index AS VARCHAR), 6, '0')) AS object_id, line AS text, line_index AS order_index, line_index, trim(line) = '' AS is_blank, 'utf-8' AS encoding FROM lines")
def text_objects(spark, sf_dir):
    """A line object for each line of the documents' texts."""
    return files.text_objects(_files(spark, sf_dir)).select("object_id", "text", "order_index", "line_index", "is_blank", F.element_at("metadata", "encoding").alias("encoding"))


@query(f"WITH {LINES} SELECT file_id, line AS text, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_index) - 1 AS INT) AS order_index, line_index FROM lines WHERE {_strip('line')} <> ''")
def text_objects_dense(spark, sf_dir):
    return files.text_objects(_files(spark, sf_dir), keep_blank=False).select("file_id", "text", "order_index", "line_index")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'windows-1252' ELSE 'utf-8' END AS encoding, CASE WHEN doc_id % 4 = 0 THEN concat('é', regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')) ELSE text END AS text FROM documents WHERE doc_id % 4 IN (0, 1)")
def decoded_texts(spark, sf_dir):
    """Texts of two encodings, told apart by their bytes."""
    plain = F.concat(F.unhex(F.lit("E9")), F.encode(F.regexp_replace("text", r"[^\x20-\x7E]", ""), "utf-8"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 4 in (0, 1)")
    content = F.when(F.col("doc_id") % 4 == 0, plain).otherwise(F.encode("text", "utf-8"))
    return docs.select("doc_id", tolerant.decoded(content).alias("d")).select("doc_id", "d.encoding", "d.text")


@query(
    f"""WITH {CORPUS}, kept AS (SELECT *, ord % 5 = 0 AS heading FROM corpus WHERE {_RAW} <> '')
SELECT file_id, CASE WHEN heading THEN 'header' ELSE 'para' END AS kind, CASE WHEN heading THEN regexp_replace(line, '^[# ]+|[# ]+$', '', 'g') ELSE {_RAW} END AS text, CAST(row_number() OVER (PARTITION BY file_id ORDER BY ord) - 1 AS INT) AS order_index FROM kept"""
)
def markdown_objects(spark, sf_dir):
    """The corpus as Markdown, every fifth line a heading."""
    rows = corpus.spec_corpus(spark, sf_dir).withColumn("line", F.when(F.col("ord") % 5 == 0, F.concat(F.lit("## "), "line", F.lit(" ##"))).otherwise(F.col("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n\n")
    return files.markdown_objects(rows.groupBy("file_id").agg(F.encode(body, "utf-8").alias("content"))).select("file_id", "kind", "text", "order_index")


_TYPES = ("Title", "page header", "Table body", "Image", "equation", "Footnote", "List item", "code", "text", "", "Figure caption")
_KINDS = ("heading", "heading", "table", "figure", "formula", "footnote", "list", "code", "paragraph", "paragraph", "figure")


@query(
    f"""WITH {CORPUS}, b AS (SELECT *, list_extract({list(_KINDS)!r}, 1 + ord % 11) AS block_kind FROM corpus)
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY ord) - 1 AS INT) AS order_index, CASE WHEN block_kind = 'heading' THEN 'header' WHEN block_kind IN ('table', 'figure') THEN block_kind ELSE 'para' END AS kind,
  CASE WHEN ord % 7 > 0 THEN nullif({_RAW}, '') END AS text, CASE ord % 5 WHEN 0 THEN 2 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE section_no - 1 END::INT AS page_index, CASE WHEN ord % 3 > 0 THEN 4 END AS n_sides, block_kind FROM b"""
)
def block_objects(spark, sf_dir):
    """The corpus as layout blocks of eleven types, with pages as numbers, texts and neither."""
    o = F.col("ord")
    page = F.when(o % 5 == 0, "3.0").when(o % 5 == 1, "x").when(o % 5 == 2, None).when(o % 5 == 3, "0").otherwise(F.col("section_no").cast("string"))
    box = F.when(o % 3 > 0, F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))).otherwise(F.array(F.lit(1.0)))
    kind = F.get(F.array(*map(F.lit, _TYPES)), o % 11)
    blocks = corpus.spec_corpus(spark, sf_dir).select("file_id", F.col("ord").cast("string").alias("id"), page.alias("page"), kind.alias("type"), F.when(o % 7 > 0, F.col("line")).otherwise("  ").alias("text"), box.alias("bbox"), "ord")
    found = files.block_objects(blocks)
    sides = F.when(F.col("bbox").isNotNull(), F.size("bbox"))
    return found.select("file_id", "order_index", "kind", "text", "page_index", sides.alias("n_sides"), F.element_at("metadata", "block_kind").alias("block_kind"))


_WORDS = "w AS (SELECT file_id, section_no - 1 AS page_index, line_idx AS line_no, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS pos FROM corpus)"


@query(
    f"""WITH {CORPUS}, {_WORDS} SELECT file_id, page_index, CAST(row_number() OVER (PARTITION BY file_id ORDER BY page_index, line_no) - 1 AS INT) AS order_index, string_agg(text, ' ' ORDER BY pos DESC) AS text,
  (500 - 10 * max(pos))::DOUBLE AS x0, (508 - 10 * min(pos))::DOUBLE AS x1, (100 * line_no)::DOUBLE AS top FROM w GROUP BY file_id, page_index, line_no"""
)
def word_lines(spark, sf_dir):
    """Lines from words whose tops differ a little, set from right to left."""
    words = corpus.spec_corpus(spark, sf_dir).select("file_id", (F.col("section_no") - 1).alias("page_index"), F.col("line_idx").alias("line_no"), F.posexplode(F.split("line", " ")).alias("pos", "text"))
    x0 = (500 - 10 * F.col("pos")).cast("double")
    top = 100.0 * F.col("line_no") + F.when(F.col("pos") == 0, 0.0).otherwise(0.04)
    placed = words.withColumns({"x0": x0, "x1": x0 + 8, "top": top, "bottom": top + 9})
    b = F.col("bbox")
    return files.word_lines(placed).select("file_id", "page_index", "order_index", "text", b[0].alias("x0"), b[2].alias("x1"), b[1].alias("top"))


@query(
    f"""WITH {CORPUS}, l AS (SELECT file_id, section_no AS page_no, (100 - line_idx)::DOUBLE AS y0, ord, line AS text FROM corpus)
SELECT file_id, page_no, CASE WHEN page_no % 3 = 0 THEN upper(text) ELSE text END AS text, CAST(row_number() OVER (PARTITION BY file_id ORDER BY page_no, y0) - 1 AS INT) AS line_idx FROM l"""
)
def recognized_pages(spark, sf_dir):
    """Pages without lines of their own, every third, get those of character recognition."""
    rows = corpus.spec_corpus(spark, sf_dir).select("file_id", F.col("section_no").alias("page_no"), (100.0 - F.col("line_idx")).alias("y0"), F.lit(0.0).alias("x0"), F.col("line").alias("text"))
    read = rows.withColumn("text", F.upper("text"))
    return files.with_recognized(rows.where("page_no % 3 > 0"), rows.select("file_id", "page_no").distinct(), read).select("file_id", "page_no", "text", "line_idx")


@query(f"WITH {OBJS} SELECT file_id FROM objects GROUP BY file_id HAVING bool_or(kind = 'figure') AND CAST(substr(file_id, 7) AS INT) % 3 = 0")
def scanned_documents(spark, sf_dir):
    """Documents with images and no text; every third has lost its text."""
    lost = F.substring("file_id", 7, 20).cast("int") % 3 == 0
    return quality.scanned_only(_objects(spark, sf_dir).withColumn("text", F.when(~lost, F.col("text")).otherwise(" ")).where(lost | F.col("text").isNotNull()))


@query(f"WITH {OBJS} SELECT object_id, kind FROM objects WHERE kind IN ('line', 'para')")
def textual_objects(spark, sf_dir):
    return documents.textual(_objects(spark, sf_dir)).select("object_id", "kind")


@query(
    f"""WITH {OBJS} SELECT CASE WHEN order_index % 10 = 3 THEN NULL ELSE object_id END AS object_id, CASE WHEN order_index % 10 IN (3, 8) THEN NULL WHEN order_index % 2 = 0 THEN page_index END::INT AS page_index,
  CASE WHEN order_index % 10 = 3 THEN 'malformed' WHEN order_index % 10 = 8 THEN 'missing kind' END AS problem FROM objects"""
)
def checked_objects(spark, sf_dir):
    """Objects from JSON: pages as texts or as no numbers, some records torn, some without their kind."""
    o = F.col("order_index")
    page = F.when(o % 10 == 8, None).when(o % 2 == 0, F.col("page_index").cast("string")).otherwise("none")
    whole = F.to_json(F.struct("object_id", "file_id", F.when(o % 10 != 8, F.col("kind")).alias("kind"), "text", page.alias("page_index")))
    told = tolerant.checked(_objects(spark, sf_dir).select(F.when(o % 10 == 3, F.substring(whole, 1, 20)).otherwise(whole).alias("json")))
    return told.select("object_id", "page_index", "problem")


@query(f"WITH {HEADERS} SELECT section_number, regexp_replace(section_name, '\\s+', ' ', 'g') AS section_name, CAST(ord AS VARCHAR) AS page_number, '' AS line_number, 'a b' AS chunk_text FROM headers")
def header_report(spark, sf_dir):
    """The rows of the header search report."""
    found = _headers(spark, sf_dir).select("section_number", "section_name", F.col("ord").alias("page_number"), F.lit(None).cast("int").alias("line_number"), F.lit(" a \n\t b ").alias("chunk_text"))
    return sinks.header_report(found)


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def last_entries(spark, sf_dir):
    """The log's last rows: the limit is the feature."""
    return progress.last_entries(table(spark, sf_dir, "events")).select("event_id", "event_type")


_A, _B = _fold("line"), _fold("before")


@query(
    f"""WITH {CORPUS}, p AS (SELECT file_id, ord, line, CASE WHEN ord % 3 = 0 THEN upper(substr(line, 1, 9)) ELSE lag(line) OVER (PARTITION BY file_id ORDER BY ord) END AS before FROM corpus)
SELECT file_id, ord, coalesce({_A} <> '' AND {_B} <> '' AND (starts_with({_A}, {_B}) OR starts_with({_B}, {_A})), false) AS alike FROM p"""
)
def heading_alike(spark, sf_dir):
    """Whether a line and the one before it, or its own beginning in capitals, begin alike."""
    before = F.when(F.col("ord") % 3 == 0, F.upper(F.substring("line", 1, 9))).otherwise(F.lag("line").over(W.partitionBy("file_id").orderBy("ord")))
    return corpus.spec_corpus(spark, sf_dir).withColumn("before", before).select("file_id", "ord", text.heading_alike(F.col("line"), F.col("before")).alias("alike"))


@query(
    "SELECT doc_id, substr(text, greatest(n_chars // 2 - 200, 0) + 1, least(length(text), n_chars // 2 + 200) - greatest(n_chars // 2 - 200, 0)) AS evidence, "
    "regexp_replace(regexp_replace(lower(left(text, 60)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, sha256(text) AS sha256, "
    "CASE WHEN doc_id % 3 = 0 THEN '***' WHEN length(text) > 200 THEN concat(left(text, 200), '...') ELSE text END AS shown FROM documents"
)
def traced_texts(spark, sf_dir):
    """Evidence around the middle of a text, its slug and digest, and what a trace shows of it under two names."""
    c, key = F.col("text"), F.when(F.col("doc_id") % 3 == 0, "API_Key").otherwise("note")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.window(c, F.floor(F.col("n_chars") / 2).cast("int")).alias("evidence"), text.slug(F.left(c, F.lit(60))).alias("slug"), F.sha2(c, 256).alias("sha256"), text.redacted(key, c).alias("shown")
    )


@query(f"WITH {CORPUS} SELECT file_id, section_no, concat('Section ', section_no, ' (N/A)', chr(10), left(string_agg(line, chr(10) ORDER BY ord), 10000), chr(10), 'End') AS prompt FROM corpus GROUP BY file_id, section_no")
def section_prompts(spark, sf_dir):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    parts = corpus.spec_corpus(spark, sf_dir).groupBy("file_id", "section_no").agg(body.alias("section_text"))
    named = parts.withColumns({"section_number": F.lit(""), "section_name": F.concat(F.lit("Section "), "section_no")})
    return documents.section_prompts(named, "{section_name} ({section_number})\n{section_text}\nEnd").select("file_id", "section_no", "prompt")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat_ws(chr(10), left(text, 90), lang, source) WHEN 1 THEN concat_ws(chr(10), nullif(left(text, 90), ''), lang) ELSE left(text, 90) END AS said FROM documents")
def reasoning_texts(spark, sf_dir):
    """What JSON of three shapes says: an object with a list, a list with an object, a text."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.left("text", F.lit(90)))
    whole = F.to_json(F.struct(F.col("t").alias("content"), F.array("lang", "source").alias("text")))
    listed = F.concat(F.lit("["), F.to_json(F.struct(F.col("t").alias("text"))), F.lit(", 5, "), F.to_json(F.struct(F.col("lang").alias("content"))), F.lit("]"))
    said = F.regexp_extract(F.to_json(F.struct("t")), r'(?s)^\{"t":(.*)\}$', 1)
    d = F.col("doc_id") % 3
    return docs.select("doc_id", tolerant.reasoning_text(F.when(d == 0, whole).when(d == 1, listed).otherwise(said)).alias("said"))


_SHOWN = " OR ".join(f"regexp_matches({_RAW}, '{p}')" for p in text.SHOWN_TOC)


@query(
    f"""WITH {HEADERS}, met AS (SELECT h.file_id, h.position, c.ord, CASE WHEN starts_with(l, {_fold("concat_ws(' ', section_number, section_name)")}) THEN 1
    WHEN starts_with(l, {_fold('section_number')}) AND contains(l, {_fold('section_name')}) THEN 2 WHEN contains(l, {_fold('section_name')}) THEN 3 END AS rule
  FROM headers h JOIN (SELECT file_id, ord, {_fold('line')} AS l FROM corpus WHERE NOT ({_SHOWN})) c ON c.file_id = h.file_id),
located AS (SELECT file_id, position, arg_min(ord, rule * 100000 + ord) AS start FROM met WHERE rule IS NOT NULL GROUP BY file_id, position)
SELECT h.file_id, h.position, l.start FROM headers h LEFT JOIN located l USING (file_id, position)"""
)
def shown_anchors(spark, sf_dir):
    """Where headers begin when contents lines are passed over."""
    rows = corpus.spec_corpus(spark, sf_dir)
    return headers.located(_headers(spark, sf_dir), rows.where(~text.is_shown_toc(F.col("line")))).select("file_id", "position", "start")


@query(f"WITH {HEADERS} SELECT file_id, position, sha1(concat_ws('|', file_id, section_number, section_name)) AS section_id, sha1(concat_ws('|', sha1(concat_ws('|', file_id, section_number, section_name)), section_name)) AS line_id FROM headers")
def section_ids(spark, sf_dir):
    made = _headers(spark, sf_dir).withColumn("section_id", identity.header_section_id(F.col("file_id"), F.col("section_number"), F.col("section_name")))
    return made.select("file_id", "position", "section_id", identity.section_line_id(F.col("section_id"), F.col("section_name")).alias("line_id"))


@query(f"SELECT file_id, spec_id, CAST(row_number() OVER (ORDER BY section_title, spec_id, file_id) AS INT) AS place FROM ({_LISTED})")
def export_places(spark, sf_dir):
    """Each item's place in the order of exports, over all documents."""
    return sequences.placed(_specs(spark, sf_dir).select("file_id", "section_title", "spec_id"), ["section_title", "spec_id", "file_id"]).select("file_id", "spec_id", "place")
