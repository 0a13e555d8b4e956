"""Specification items from section lines: the rule atomizer and the fallback of leaf sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity, specs, text

#: Fallback candidates of a leaf section that count: the first this many.
FALLBACK_LIMIT = 5


def bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once for each row: what reads them, filters too, doesn't ask their patterns again."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def atomize(lines: DataFrame, *kept: str) -> DataFrame:
    """A row for each candidate line of ``lines`` (file_id, section_id, line), with the columns ``kept``: the rule atomizer.

    Expressions only: no shuffle. Equal lines of a section share a spec_id; null lines give none.
    """
    cleaned = bound(lines.select("file_id", "section_id", "line", *kept), spec_text=text.clean_spec_line(F.col("line"))).where("spec_text <> ''")
    read = bound(cleaned, _low=F.lower("spec_text"), _unit=F.regexp_extract("spec_text", specs.VALUE_UNIT, 2))
    found = read.where((F.col("_unit") != "") | F.col("_low").rlike("|".join(specs.TRIGGERS)))
    raw = F.when(F.col("_unit") != "", F.regexp_extract("spec_text", specs.VALUE_UNIT, 1))
    value = bound(bound(found, _raw=raw), v=specs.converted(F.col("_raw"), F.col("_unit")))
    group = bound(value, category=specs.category(F.col("spec_text"), F.col("v.normalized_unit")))
    return group.select(
        identity.spec_id(F.col("file_id"), F.col("section_id"), F.col("spec_text")).alias("spec_id"),
        "file_id",
        "section_id",
        "spec_text",
        "v.*",
        "category",
        specs.confidence(F.col("spec_text"), F.col("v.raw_value").isNotNull(), F.col("category")).alias("confidence"),
        *kept,
    )


def fallback_specs(lines: DataFrame) -> DataFrame:
    """The first candidates of each section by unit, standard body, bullet or number; ``lines`` has ord (document order) too.

    ``spec_index`` counts from 0 in the section and is part of the id, as candidates are numbered before duplicates go.
    """
    in_section = W.partitionBy("file_id", "section_id").orderBy("ord")
    stripped = bound(lines, raw=text.strip(F.col("line")))
    return (
        bound(stripped.where((F.col("raw") != "") & specs.is_fallback_candidate(F.col("raw"))), spec_text=text.normalize_spec_line(F.col("raw")))
        .where("spec_text <> ''")
        .withColumn("spec_index", F.row_number().over(in_section) - 1)
        .where(F.col("spec_index") < FALLBACK_LIMIT)
        .select(
            identity.leaf_spec_id(F.col("file_id"), F.col("section_id"), F.col("spec_index"), F.col("spec_text")).alias("spec_id"),
            "file_id",
            "section_id",
            "ord",
            "spec_index",
            "spec_text",
        )
    )


def dedup_specs(found: DataFrame, sources: DataFrame) -> DataFrame:
    """The first of specs with equal text, but for case, and equal source objects, across a document's sections.

    ``sources``: file_id, section_id, source_object_ids.
    """
    first = W.partitionBy("file_id", "source_object_ids", F.lower("spec_text")).orderBy("ord", "spec_index")
    return (
        found.join(sources, ["file_id", "section_id"])
        .withColumn("rank", F.row_number().over(first))
        .where("rank = 1")
        .drop("rank")
    )


def section_sources(lines: DataFrame) -> DataFrame:
    """The object ids of each section, sorted; an object for each line."""
    return lines.groupBy("file_id", "section_id").agg(
        F.sort_array(F.collect_list(identity.numbered(F.col("file_id"), "txt", F.col("ord")))).alias("source_object_ids")
    )


def with_sources(lines: DataFrame) -> DataFrame:
    """``lines`` of known sections with ``source_object_ids``, those of ``section_sources``: a window over a section in place of a join."""
    section = W.partitionBy("file_id", "section_id").orderBy("_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = lines.where("file_id is not null and section_id is not null").select("*", F.explode(F.array(identity.numbered(F.col("file_id"), "txt", F.col("ord")))).alias("_id"))
    return named.withColumn("source_object_ids", F.collect_list("_id").over(section)).drop("_id")
