"""Documents put together again: chunks with their objects, headers with pages and texts, rows of several kinds in one order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import headers as H
from . import toc

# Names that a column may have, the first that is there and not null counts; how much of a section a prompt takes.
ALIASES = {
    "section_number": ("section_number", "section", "sectionNumber"),
    "section_name": ("section_name", "section_title", "sectionName"),
    "specification": ("specification", "spec_text", "text"),
    "domain": ("domain", "category", "group"),
}
SECTION_LIMIT = 10_000


TEXTUAL = ("line", "para")


def textual(objects: DataFrame) -> DataFrame:
    """Objects of the kinds that hold running text."""
    return objects.where(F.col("kind").isin(*TEXTUAL))


def chunk_objects(chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """The objects of each chunk (file_id, section_id, object_ids), ``at`` their places in it; ids of no object are skipped, null lists are empty."""
    each = chunks.select("file_id", "section_id", F.posexplode("object_ids").alias("at", "object_id"))
    return each.join(objects, ["file_id", "object_id"])


def chunk_texts(chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """file_id, section_id, n_objects, text: a chunk's texts in its order, a line each; chunks without any object are left out."""
    rows = F.array_sort(F.collect_list(F.struct("at", "text")))
    return chunk_objects(chunks, objects).groupBy("file_id", "section_id").agg(F.count(F.lit(1)).alias("n_objects"), F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def in_one_order(*kinds: DataFrame) -> DataFrame:
    """Objects of several tables under one order_index: all of a file's first table by page and old index, then the second's, and so on."""
    ranked = [df.withColumn("_class", F.lit(k)) for k, df in enumerate(kinds)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    order = W.partitionBy("file_id").orderBy("_class", F.coalesce("page_index", F.lit(0)), "order_index", "object_id")
    return both.withColumn("order_index", F.row_number().over(order) - 1).drop("_class")


def renamed(rows: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """The columns of ``aliases`` as text, each from those of its names that ``rows`` has; empty where none has a value."""

    def value(names: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.col(c).cast("string") for c in names if c in rows.columns), F.lit(""))

    return rows.select(*(value(names).alias(c) for c, names in aliases.items()))


def page_with_total(rows: DataFrame, order: list[Column | str], page: int, size: int) -> DataFrame:
    """A page, from 1, of the ordered rows, with the number of all rows as ``total``."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total", rows.select(F.count(F.lit(1))).scalar())


def flat_headers(tree: DataFrame) -> DataFrame:
    """file_id, place (from 1, down the tree), section_number, section_name, page_number (from 1), line_number, chunk_text of a tree's nodes."""
    place = F.row_number().over(W.partitionBy("file_id").orderBy("position"))
    return tree.select(
        "file_id", place.alias("place"), F.coalesce("section_number", F.lit("")).alias("section_number"), "section_name",
        (F.col("page") + 1).alias("page_number"), F.col("line").alias("line_number"), F.col("section_name").alias("chunk_text"),
    )


def children_in_order(headers: DataFrame) -> DataFrame:
    """Adds child_place, from 1: a header's place among those of the same ``parent_number``, numbers compared as numbers."""
    order = W.partitionBy("file_id", "parent_number").orderBy("sort_key", "position")
    return headers.withColumn("child_place", F.row_number().over(order))


def header_records(headers: DataFrame, lines: DataFrame, likeness: bool = True) -> DataFrame:
    """file_id, position, page_number, line_number, chunk_text of each header, from ``lines`` (file_id, ord, line, page, line_idx).

    Contents lines and pages don't count, unless nothing else is left of a document. Pages are told from 1; a line without an index of its own by its place
    among those that count. The text is that of the section; without any, the header's number and name. Without ``likeness`` headers that no line has stay
    unplaced.
    """
    flagged = toc.marked_pages(lines).withColumn("_real", ~F.col("contents") & ~F.col("entry"))
    kept = flagged.withColumn("_any", F.max("_real").over(W.partitionBy("file_id"))).where("_real or not _any")
    counted = kept.select(*lines.columns).withColumn("ord", F.row_number().over(W.partitionBy("file_id").orderBy("ord")) - 1)
    made = H.sections(headers, counted, "page", "line_idx", texts=True, alike=likeness, sizes=lines)
    name = T.strip(F.concat_ws(" ", "section_number", "section_name"))
    return made.select(
        "file_id", "position", (F.col("page") + 1).alias("page_number"), F.when(F.col("start").isNotNull(), F.coalesce("line_idx", "start") + 1).alias("line_number"),
        F.coalesce(F.nullif(T.strip(F.col("section_text")), F.lit("")), name).alias("chunk_text"),
    )


def recognized_lines(words: DataFrame, scale_x: Column, scale_y: Column) -> DataFrame:
    """Lines from recognized words (file_id, page_no, at, block, line, text, left, top, width, height, all in pixels), as points.

    A block's line is one; its words go as they came (``at``), its font is as large as its highest word. Lines go by their top; blank words are none.
    """
    real = words.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    said = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    made = real.groupBy("file_id", "page_no", "block", "line").agg(
        T.strip(F.array_join(said, " ")).alias("text"),
        F.array(F.min("left") * scale_x, F.min("top") * scale_y, F.max(F.col("left") + F.col("width")) * scale_x, F.max(F.col("top") + F.col("height")) * scale_y).alias("bbox"),
        (F.max("height") * scale_y).alias("font_size"),
        F.min("at").alias("_first"),
    )
    order = W.partitionBy("file_id", "page_no").orderBy(F.col("bbox")[1], "_first")
    caps = F.col("text").rlike(r"\p{L}") & (F.upper("text") == F.col("text"))
    return made.select("file_id", "page_no", (F.row_number().over(order) - 1).alias("line_no"), "text", "bbox", "font_size", caps.alias("is_caps"))


def filled(template: str, **values: Column) -> Column:
    """A prompt: ``template`` with each {name} replaced by a column, null as nothing; an unknown name is an error."""
    parts, at = [], 0
    for name in sorted(values, key=lambda n: template.index(f"{{{n}}}")):
        start = template.index(f"{{{name}}}")
        parts += [F.lit(template[at:start]), F.coalesce(values[name].cast("string"), F.lit(""))]
        at = start + len(name) + 2
    return F.concat(*parts, F.lit(template[at:]))


def section_prompts(sections: DataFrame, template: str) -> DataFrame:
    """Adds prompt: ``template`` with {section_number} (N/A without one), {section_name} and {section_text}, cut to ``SECTION_LIMIT`` characters."""
    number = F.coalesce(F.nullif("section_number", F.lit("")), F.lit("N/A"))
    return sections.withColumn("prompt", filled(template, section_number=number, section_name=F.col("section_name"), section_text=F.substring("section_text", 1, SECTION_LIMIT)))
