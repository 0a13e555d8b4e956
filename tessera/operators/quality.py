"""Quality report of specification items against sections and chunks, and engine choice for files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(objects: DataFrame, leaves: DataFrame, specs: DataFrame) -> DataFrame:
    """file_id, objects, leaves, specs, ratio of leaves that have a spec; 0 without leaves.

    All three are counted by section and then by document: sums that tasks make before they exchange any.
    """
    kinds = {"o": objects.select("file_id", F.lit(None).cast("string").alias("section_id")), "l": leaves.select("file_id", "section_id"), "s": specs.select("file_id", "section_id")}
    one = [df.select("*", *(F.lit(int(k == c)).alias(c) for c in kinds)) for k, df in kinds.items()]
    sections = reduce(DataFrame.unionByName, one).groupBy("file_id", "section_id").agg(*(F.sum(c).alias(c) for c in kinds))
    has = (F.col("s") > 0) & F.col("section_id").isNotNull() & F.col("file_id").isNotNull()
    found = sections.groupBy("file_id").agg(*(F.sum(c).alias(c) for c in kinds), F.sum(F.when(has, F.col("l")).otherwise(0)).alias("with")).where("o > 0")
    known = F.col("file_id").isNotNull()
    number = {c: F.when(known, F.col(c)).otherwise(F.lit(0)) for c in ("l", "s")}
    return found.select(
        "file_id",
        F.col("o").alias("parsed_object_count"),
        number["l"].alias("leaf_section_count"),
        number["s"].alias("specs_count"),
        F.when(number["l"] > 0, F.round(F.col("with") / F.col("l"), 6)).otherwise(0.0).alias("leaf_spec_ratio"),
    )


def consistency(specs: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_id, mismatched, duplicates, warnings: specs whose source objects aren't their section's chunk, and repeated ids.

    ``chunks``: file_id, section_id, object_ids of leaf sections.
    """
    met = specs.join(chunks, ["file_id", "section_id"], "left")
    wrong = ~F.coalesce("object_ids", F.array().cast("array<string>")).eqNullSafe(F.col("source_object_ids"))
    bad = met.groupBy("file_id").agg(F.array_sort(F.collect_list(F.when(wrong, F.col("spec_id")))).alias("mismatched"))
    twice = specs.groupBy("file_id", "spec_id").count().where("count > 1").groupBy("file_id").agg(F.array_sort(F.collect_set("spec_id")).alias("duplicates"))
    none = F.array().cast("array<string>")
    out = bad.join(twice, "file_id", "left").withColumn("duplicates", F.coalesce("duplicates", none))
    said = [
        F.when(F.size("mismatched") > 0, F.concat(F.lit("Source-object mismatch for spec_ids: "), F.array_join("mismatched", ", "))),
        F.when(F.size("duplicates") > 0, F.concat(F.lit("Duplicate spec_ids detected: "), F.array_join("duplicates", ", "))),
    ]
    return out.select(
        "file_id",
        F.size("mismatched").alias("mismatched"),
        F.size("duplicates").alias("duplicates"),
        F.array_join(F.array_compact(F.array(*said)), "\n").alias("warnings"),
    )


def fingerprints(rows: DataFrame, order: str) -> DataFrame:
    """file_id, sha256 of each document's rows as JSON in order: equal for equal content."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct("*").alias("row")))), lambda x: x["row"]))
    return rows.groupBy("file_id").agg(F.sha2(body, 256).alias("sha256"))


def engine_choice(objects: DataFrame) -> DataFrame:
    """file_id, text_chars, has_images, has_tables, engine: layout analysis for documents of little text with images, or with images and no tables."""
    kind = F.col("kind")
    stats = objects.groupBy("file_id").agg(
        F.sum(F.when(kind.isin("line", "para"), F.char_length(F.coalesce("text", F.lit("")))).otherwise(0)).alias("text_chars"),
        F.bool_or(kind == "figure").alias("has_images"),
        F.bool_or(kind == "table").alias("has_tables"),
    )
    layout = ((F.col("text_chars") < 200) & F.col("has_images")) | (~F.col("has_tables") & F.col("has_images"))
    return stats.withColumn("engine", F.when(layout, "layout").otherwise("native"))


def scanned_only(objects: DataFrame) -> DataFrame:
    """file_id of documents with images and no text: to be refused without character recognition."""
    return (
        objects.groupBy("file_id")
        .agg(F.bool_or((F.trim(F.coalesce("text", F.lit(""))) != "")).alias("text"), F.bool_or(F.col("kind") == "figure").alias("images"))
        .where("images and not text")
        .select("file_id")
    )
