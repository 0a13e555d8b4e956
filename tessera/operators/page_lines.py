"""Text lines from pages as a layout parser nests them: blocks of lines of spans, each with its font."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import column_of

#: A page: what the parser writes as JSON.
PAGES = (
    "file_id string, page_no int, width double, height double, blocks array<struct<type:int,bbox:array<double>,"
    "lines:array<struct<bbox:array<double>,spans:array<struct<text:string,font:string,size:double,flags:int>>>>>>"
)
# Blocks with lines, the bit of a bold span's flags.
BLOCK_TYPES, BOLD = (0, 1), 2


def _line(x: Column) -> Column:
    """What a line's spans say together: the first font, the mean size, bold if one is."""
    spans = x["spans"]
    fonts = F.filter(F.transform(spans, lambda s: s["font"]), lambda f: f.isNotNull() & (f != ""))
    sizes = F.filter(F.transform(spans, lambda s: s["size"]), lambda v: v.isNotNull() & (v != 0))
    said = F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "")
    bold = F.exists(spans, lambda s: (F.coalesce(s["flags"], F.lit(0)).bitwiseAND(BOLD) != 0) | F.coalesce(F.lower(s["font"]).contains("bold"), F.lit(False)))
    return F.struct(
        F.coalesce(x["bbox"], F.array_repeat(F.lit(0.0), 4)).alias("bbox"),
        T.strip(F.translate(said, "\u00a0", " ")).alias("text"),
        F.get(fonts, F.lit(0)).alias("font_family"),
        (F.aggregate(sizes, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(sizes), F.lit(0))).alias("font_size"),
        bold.alias("is_bold"),
        fonts.alias("span_fonts"),
        F.aggregate(spans, F.lit(0), lambda a, s: a.bitwiseOR(F.coalesce(s["flags"], F.lit(0)))).alias("flags"),
    )


def _columns(middles: pd.Series) -> pd.Series:
    return middles.map(lambda x: column_of(list(x)) if x is not None else [])


def text_lines(pages: DataFrame, multi_column: bool = True) -> DataFrame:
    """file_id, text, bbox, font_family, font_size, is_bold, is_caps, page_no, line_idx, column_index, span_fonts, flags, page_width, page_height.

    ``pages`` as ``PAGES``. Lines without spans or without text are none; a line without a box has zeros. Lines go by page, column, top and left
    side, then as they came; line_idx counts them in the document. A page is a row until its lines are read out: what it needs is one exchange.
    """
    blocks = F.filter(F.coalesce("blocks", F.array()), lambda b: b["type"].isin(*BLOCK_TYPES) & b["lines"].isNotNull())
    raw = F.filter(F.flatten(F.transform(blocks, lambda b: b["lines"])), lambda x: F.coalesce(F.size(x["spans"]) > 0, F.lit(False)))
    made = pages.select("file_id", "page_no", "width", "height", F.transform(raw, _line).alias("lines"))
    made = made.withColumn("lines", F.filter("lines", lambda x: x["text"] != ""))
    column = F.pandas_udf(_columns, "array<int>")(F.transform("lines", lambda x: (x["bbox"][0] + x["bbox"][2]) / 2)) if multi_column else F.transform("lines", lambda x: F.lit(0))
    each = made.withColumn("columns", column).select(
        "file_id", "page_no", "width", "height", F.posexplode(F.arrays_zip("lines", "columns")).alias("at", "x")
    )
    flat = each.select("file_id", "page_no", "at", "x.lines.*", F.col("x.columns").alias("column_index"), F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    order = W.partitionBy("file_id").orderBy("page_no", "column_index", F.col("bbox")[1], F.col("bbox")[0], "at")
    caps = F.col("text").rlike(r"\p{L}") & ~F.col("text").rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")
    return flat.select(
        "file_id", "text", "bbox", "font_family", "font_size", "is_bold", caps.alias("is_caps"), "page_no",
        (F.row_number().over(order) - 1).alias("line_idx"), "column_index", "span_fonts", "flags", "page_width", "page_height",
    )
