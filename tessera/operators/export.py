"""Exports of specification items: CSV rows and JSON, in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("spec_id", "file_id", "section_id", "section_number", "section_title", "spec_text", "confidence", "source_object_ids")


def csv_rows(specs: DataFrame, joined: str | None = None) -> DataFrame:
    """All columns as text: nulls empty, object ids as compact JSON or joined by ``joined``."""
    ids = F.array_join("source_object_ids", joined) if joined else F.to_json("source_object_ids")
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS[:-1]}
    return specs.select(*(v.alias(c) for c, v in plain.items()), F.coalesce(ids, F.lit("")).alias("source_object_ids"))


def ordered(specs: DataFrame) -> DataFrame:
    return specs.orderBy("section_title", "spec_id")


def json_payloads(specs: DataFrame) -> DataFrame:
    """file_id, payload: a document's specs as JSON, by section title and id."""
    rows = F.array_sort(F.collect_list(F.struct("section_title", "spec_id", F.struct(*COLUMNS).alias("row"))))
    body = F.transform(rows, lambda x: x["row"])
    return specs.groupBy("file_id").agg(F.to_json(F.struct(F.first("file_id").alias("file_id"), body.alias("specs"))).alias("payload"))


def whole_payloads(specs: DataFrame, sections: DataFrame) -> DataFrame:
    """file_id, payload: a document's sections (file_id, position, ...) in their order and its specs, as one JSON; a document may have either only."""
    rows = F.array_sort(F.collect_list(F.struct("position", F.struct("*").alias("row"))))
    parts = sections.groupBy("file_id").agg(F.transform(rows, lambda x: x["row"]).alias("sections"))
    items = F.array_sort(F.collect_list(F.struct("section_title", "spec_id", F.struct(*COLUMNS).alias("row"))))
    made = specs.groupBy("file_id").agg(F.transform(items, lambda x: x["row"]).alias("specs"))
    both = parts.join(made, "file_id", "full_outer")
    empty = [F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("sections", "specs")]
    return both.select("file_id", F.to_json(F.struct("file_id", *empty), {"ignoreNullFields": "false"}).alias("payload"))
