"""Documents as lines: explosion, concatenation, cleaning, repeated lines, pages, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def document_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_index (physical, from 0), line_no (dense, from 0), line: the stripped lines that aren't blank."""
    each = docs.select(key, F.posexplode(F.transform(T.lines("text"), T.strip)).alias("line_index", "line")).where("line <> ''")
    return each.withColumn("line_no", F.row_number().over(W.partitionBy(key).orderBy("line_index")) - 1)


def object_lines(objects: DataFrame) -> DataFrame:
    """Line entries of parsed objects: lines, paragraphs and headers are one each, tables one for each line, figures none."""
    body = T.strip(F.coalesce("text", F.lit("")))
    rows = F.when(F.col("kind").isin("line", "para", "header"), F.array(body)).when(
        F.col("kind") == "table", F.transform(T.lines(body), T.strip)
    )
    each = objects.select("*", F.posexplode(F.filter(rows, lambda x: x != "")).alias("at", "entry"))
    order = W.partitionBy("file_id").orderBy(F.coalesce("page_index", F.lit(0)), "order_index", "at")
    return each.withColumns(
        {
            "line_no": F.row_number().over(order) - 1,
            "line_index": F.when(F.col("kind") != "table", F.col("line_index")),
        }
    ).drop("at")


def joined(lines: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each key's values in order, joined by line breaks."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[value]), "\n").alias("text"))


def repeated_lines(lines: DataFrame, key: str, parts: int = 8, least: int = 10) -> DataFrame:
    """key, line, n: lines so frequent in a document that they are its header or footer."""
    each = lines.groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(W.partitionBy(key))
    return each.withColumn("size", size).where(F.col("n") > F.greatest(F.floor(F.col("size") / parts), F.lit(least))).drop("size")


def marked_repeated(lines: DataFrame, key: str, parts: int = 8, least: int = 10) -> DataFrame:
    """``lines`` (key, line, ...) with ``repeated``, whether a line is one of ``repeated_lines`` of those that aren't blank; by windows over a document."""
    real = F.when(F.col("line") != "", 1)
    document = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = lines.withColumn("_size", F.count(real).over(document)).withColumn("_n", F.count(real).over(W.partitionBy(key, "line")))
    many = F.col("_n") > F.greatest(F.floor(F.col("_size") / parts), F.lit(least))
    return counted.withColumn("repeated", many & F.col(key).isNotNull()).drop("_size", "_n")


def without_repeated(lines: DataFrame, key: str) -> DataFrame:
    return lines.join(repeated_lines(lines, key).select(key, "line"), [key, "line"], "left_anti")


def renumbered(objects: DataFrame) -> DataFrame:
    """order_index made dense in document order: by page, null first, then by the old index."""
    order = W.partitionBy("file_id").orderBy(F.coalesce("page_index", F.lit(0)), "order_index", "object_id")
    return objects.withColumn("order_index", F.row_number().over(order) - 1)


def paginated(rows: DataFrame, order: list[Column | str], page: int, size: int) -> DataFrame:
    """A page, from 1, of the ordered rows."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def filtered(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that have the query, case aside, in their columns joined by spaces."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(query.lower()))
