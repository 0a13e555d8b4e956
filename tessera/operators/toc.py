"""Tables of contents: entries, pages, and lines that are none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Pages from the first in which contents are looked for.
SEARCH_PAGES = 10


def toc_pages(lines: DataFrame) -> DataFrame:
    """file_id, page of contents pages, from ``lines`` (file_id, page, line).

    A run of pages with two entries or a heading each is contents from its first page with three entries or a
    heading on. A page without lines breaks a run.
    """
    pages = (
        lines.where(F.col("page") < SEARCH_PAGES)
        .groupBy("file_id", "page")
        .agg(
            F.sum(T.is_toc_entry(F.col("line")).cast("int")).alias("hits"),
            F.max(F.col("line").rlike(T.TOC_HEADING)).alias("heading"),
        )
    )
    stays = (F.col("hits") >= 2) | F.col("heading")
    order = W.partitionBy("file_id").orderBy("page")
    # Pages of a run have the same difference of page and rank among the pages that stay.
    runs = pages.where(stays).withColumn("run", F.col("page") - F.row_number().over(order))
    start = ((F.col("hits") >= 3) | F.col("heading")).cast("int")
    so_far = F.max(start).over(W.partitionBy("file_id", "run").orderBy("page"))
    return runs.withColumn("in", so_far).where("in = 1").select("file_id", "page")


def marked_pages(lines: DataFrame) -> DataFrame:
    """``lines`` with ``entry``, whether a line is one of contents, and ``contents``, whether its page is one of ``toc_pages``: by windows over a document.

    Of a run's pages the last to start contents comes after the last page in front of it that doesn't stay or isn't there.
    """
    page = F.col("page")
    bound = lines.select("*", F.explode(F.array(F.coalesce(T.is_toc_entry(F.col("line")), F.lit(False)))).alias("entry"))
    order = W.partitionBy("file_id").orderBy("page")
    own, so_far = order.rangeBetween(0, 0), order.rangeBetween(W.unboundedPreceding, 0)
    told = bound.withColumns(
        {"_hits": F.sum(F.col("entry").cast("int")).over(own), "_heading": F.coalesce(F.max(F.col("line").rlike(T.TOC_HEADING)).over(own), F.lit(False)), "_before": F.lag("page").over(order)}
    )
    stays = (page < SEARCH_PAGES) & ((F.col("_hits") >= 2) | F.col("_heading"))
    starts = (page < SEARCH_PAGES) & ((F.col("_hits") >= 3) | F.col("_heading"))
    gap = F.when(~stays, page).when(F.col("_before") < page - 1, page - 1)
    marked = told.withColumns({"_start": F.max(F.when(starts, page)).over(so_far), "_gap": F.max(gap).over(so_far)})
    inside = stays & F.col("_start").isNotNull() & (F.col("_gap").isNull() | (F.col("_start") > F.col("_gap")))
    return marked.select(*lines.columns, "entry", F.coalesce(inside, F.lit(False)).alias("contents"))


def real_header_lines(lines: DataFrame) -> DataFrame:
    """Lines that aren't on a contents page and aren't an entry."""
    return lines.join(toc_pages(lines), ["file_id", "page"], "left_anti").where(~T.is_toc_entry(F.col("line")))
