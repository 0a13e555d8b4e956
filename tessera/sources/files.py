"""Readers of files into parsed objects: text, DOCX, Markdown, layout blocks, JSON lines; PDF through a hook.

All give columns of one wide table of objects: object_id, file_id, kind, text, page_index, order_index, line_index,
is_blank, bbox, metadata. A file is read by one task; files are spread over tasks.
"""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import text as T
from . import tolerant

OBJECT = "object_id string, file_id string, kind string, text string, page_index int, order_index int, line_index int, is_blank boolean, bbox array<double>, metadata map<string,string>"
EXTENSIONS = ("pdf", "docx", "txt")
MAX_MB = 50
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def binary(spark: SparkSession, path: str, max_mb: int = MAX_MB) -> DataFrame:
    """path, content, length, extension, problem (null, 'extension' or 'size'), and file_id: the SHA-256 of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = extension(F.col("path"))
    return files.select(
        "path",
        "content",
        "length",
        kind.alias("extension"),
        F.when(~kind.isin(*EXTENSIONS), "extension").when(F.col("length") > max_mb * 1_000_000, "size").alias("problem"),
        F.sha2("content", 256).alias("file_id"),
    )


def _objects(rows: DataFrame, kind: str) -> DataFrame:
    more = [x for c in ("heading", "encoding") if f"_{c}" in rows.columns for x in (F.lit(c), F.col(f"_{c}").cast("string"))]
    heading = F.create_map(*more).cast("map<string,string>")
    return rows.select(
        identity.numbered(F.col("file_id"), kind, F.col("order_index")).alias("object_id"),
        "file_id",
        F.lit("line").alias("kind"),
        F.col("line").alias("text"),
        F.lit(0).alias("page_index"),
        "order_index",
        "line_index",
        (F.trim("line") == "").alias("is_blank"),
        F.lit(None).cast("array<double>").alias("bbox"),
        F.map_concat(F.create_map(F.lit("source"), F.lit(kind)), heading).alias("metadata"),
    )


def text_objects(files: DataFrame, keep_blank: bool = True) -> DataFrame:
    """A line object for each line; without ``keep_blank`` blank lines go and order_index stays dense.

    Bytes that aren't UTF-8 are windows-1252; a file that is no text has no objects.
    """
    read = files.select("file_id", tolerant.decoded(F.col("content")).alias("d")).where("d.problem is null")
    rows = read.select("file_id", F.col("d.encoding").alias("_encoding"), F.posexplode(T.lines(F.col("d.text"))).alias("line_index", "line"))
    if keep_blank:
        return _objects(rows.withColumn("order_index", F.col("line_index")), "txt")
    order = W.partitionBy("file_id").orderBy("line_index")
    full = rows.where(T.strip(F.col("line")) != "").withColumn("order_index", F.row_number().over(order) - 1)
    return _objects(full, "txt")


def _docx(content: bytes, joined: bool) -> list[tuple[str, str, dict]]:
    """(kind, text, metadata): the paragraphs that aren't empty, then the tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def said(node) -> str:
        return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" for x in node.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))

    out, tables = [], []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and (text := said(node).strip()):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            out.append(("para", text, {"style": style.get(f"{_W}val", "")} if style is not None else {}))
        elif node.tag == f"{_W}tbl":
            rows = [["\n".join(said(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")]
            if joined:
                text = "\n".join("\t".join(r) for r in rows)
            else:
                rows = [r for r in rows if any(r)]
                text = "\n".join(", ".join(c for c in r if c) for r in rows)
            if text.strip():
                tables.append(("table", text, {"n_rows": str(len(rows)), "n_cols": str(max(map(len, rows), default=0)), "rows": json.dumps(rows, ensure_ascii=False)}))
    return out + tables


def docx_objects(files: DataFrame, joined: bool = True) -> DataFrame:
    """Paragraphs, then tables: cells joined by tabs, or (not ``joined``) those that aren't empty by commas. A file that can't be read has none."""
    return _docx_rows(files, joined).where("kind <> 'problem'")


def docx_problems(files: DataFrame) -> DataFrame:
    """file_id, problem of files that aren't such archives."""
    return _docx_rows(files, True).where("kind = 'problem'").select("file_id", F.col("text").alias("problem"))


def _docx_rows(files: DataFrame, joined: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, content in zip(pdf["file_id"], pdf["content"], strict=True):
                try:
                    found = _docx(bytes(content), joined)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, NotImplementedError, EOFError) as e:
                    found = [("problem", f"{type(e).__name__}: {e}", {})]
                for i, (kind, text, meta) in enumerate(found):
                    name = "docx-table" if kind == "table" else "docx-text"
                    rows.append((f"{file_id}-{name}-{i:06d}", file_id, kind, text, None, i, None, False, None, meta))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OBJECT.split(", ")])

    return files.select("file_id", "content").mapInPandas(run, OBJECT)


def markdown_objects(files: DataFrame) -> DataFrame:
    """Headings from lines that begin with #, paragraphs from the other lines that aren't blank."""
    rows = files.select("file_id", F.posexplode(T.lines(tolerant.decoded(F.col("content"))["text"])).alias("line_index", "raw")).where(T.strip(F.col("raw")) != "")
    heading = F.col("raw").startswith("#")
    order = W.partitionBy("file_id").orderBy("line_index")
    made = rows.withColumn("line", F.when(heading, F.regexp_replace("raw", "^[# ]+|[# ]+$", "")).otherwise(T.strip(F.col("raw")))).withColumn("order_index", F.row_number().over(order) - 1)
    return _objects(made.withColumn("_heading", heading), "md").withColumn(
        "kind", F.when(F.element_at("metadata", "heading") == "true", "header").otherwise("para")
    )


#: Kinds of blocks by what their type contains, in this order.
BLOCK_KINDS = (("title", "heading"), ("head", "heading"), ("table", "table"), ("image", "figure"), ("figure", "figure"), ("equation", "formula"), ("formula", "formula"), ("footnote", "footnote"), ("list", "list"), ("code", "code"))


def as_int(c: Column) -> Column:
    """A whole number from a number or a text, else null."""
    return F.trim(c.cast("string")).try_cast("double").cast("int")


def as_bool(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n"), False)


def block_kind(c: Column) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.when(F.lit(False), "")
    for part, kind in BLOCK_KINDS:
        out = out.when(F.contains(low, F.lit(part)), kind)
    return out.otherwise("paragraph")


def block_objects(blocks: DataFrame) -> DataFrame:
    """Objects from layout blocks (file_id, id, page, type, text, bbox array, ord): pages from 1 become pages from 0, blank texts null."""
    kind = block_kind(F.col("type"))
    page = as_int(F.col("page"))
    order = W.partitionBy("file_id").orderBy("ord")
    return blocks.select(
        "file_id",
        (F.row_number().over(order) - 1).alias("order_index"),
        F.when(kind == "heading", "header").when(kind.isin("table", "figure"), kind).otherwise("para").alias("kind"),
        F.nullif(T.strip(F.coalesce("text", F.lit(""))), F.lit("")).alias("text"),
        F.when(page > 0, page - 1).otherwise(page).alias("page_index"),
        F.when(F.size("bbox") == 4, F.col("bbox").cast("array<double>")).alias("bbox"),
        F.create_map(F.lit("type"), F.coalesce("type", F.lit("")), F.lit("block_kind"), kind).alias("metadata"),
    ).withColumns({"object_id": identity.numbered(F.col("file_id"), "block", F.col("order_index")), "line_index": F.lit(None).cast("int"), "is_blank": F.col("text").isNull()})


def read_jsonl(spark: SparkSession, path: str, schema: str = OBJECT) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """section_id, header_path, depth, object_ids from a JSON map of ids by section, or from a list of such records; ids may be numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    listed = F.col("value").startswith("[")
    ids = F.col("object_ids")
    by_section = whole.where(~listed).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("section_id", "object_ids"))
    plain = by_section.select("section_id", F.col("section_id").alias("header_path"), F.lit(0).alias("depth"), ids)
    record = "array<struct<section_id:string,header_path:string,depth:int,object_ids:array<string>>>"
    records = whole.where(listed).select(F.inline(F.from_json("value", record))).where("section_id is not null")
    told = records.select("section_id", F.coalesce("header_path", "section_id").alias("header_path"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce(ids, F.array().cast("array<string>")).alias("object_ids"))
    return plain.unionByName(told)


def pdf_objects(files: DataFrame, parser: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """Objects from PDF files by ``parser``, a function of a file's bytes that gives dicts of kind, text, page_index, bbox.

    No PDF library is required; without a parser this raises.
    """
    if parser is None:
        raise NotImplementedError("reading PDF needs a parser: a function of the file's bytes that gives objects")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, content in zip(pdf["file_id"], pdf["content"], strict=True):
                for i, o in enumerate(parser(bytes(content))):
                    meta = {k: json.dumps(v) for k, v in (o.get("metadata") or {}).items()}
                    rows.append((f"{file_id}-pdf-{i:06d}", file_id, o.get("kind", "para"), o.get("text"), o.get("page_index"), i, o.get("line_index"), False, o.get("bbox"), meta))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OBJECT.split(", ")])

    return files.select("file_id", "content").mapInPandas(run, OBJECT)


def word_lines(words: DataFrame) -> DataFrame:
    """Lines from words (file_id, page_index, line_no, top, x0, x1, bottom, text): words of a line and height, left to right."""
    made = words.groupBy("file_id", "page_index", "line_no", F.round("top", 1).alias("top_at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.array(F.min("x0"), F.min("top"), F.max("x1"), F.max("bottom")).alias("bbox"),
    )
    order = W.partitionBy("file_id").orderBy("page_index", "top_at", "line_no")
    return made.withColumn("order_index", F.row_number().over(order) - 1)


def with_recognized(lines: DataFrame, pages: DataFrame, recognized: DataFrame) -> DataFrame:
    """``lines`` and, for pages without any, the lines of character recognition; numbered anew by page, y0, x0."""
    bare = pages.join(lines.select("file_id", "page_no").distinct(), ["file_id", "page_no"], "left_anti")
    both = lines.unionByName(recognized.join(bare, ["file_id", "page_no"], "left_semi"), allowMissingColumns=True)
    return both.withColumn("line_idx", F.row_number().over(W.partitionBy("file_id").orderBy("page_no", "y0", "x0")) - 1)
