"""Readers that keep a job alive: what can't be read becomes a row that says so, beside the rows of what can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What the bytes 0x80 to 0x9F are in windows-1252, those that it leaves out aside.
_LATIN = "".join(map(chr, (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F)))
_WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: A parsed object's fields; a page or an order may come as a number or as a text.
FIELDS = {
    "object_id": "string", "file_id": "string", "kind": "string", "text": "string", "page_index": "int", "order_index": "int", "line_index": "int", "is_blank": "boolean", "bbox": "array<double>",
}
REQUIRED = ("object_id", "file_id", "kind")
#: Side tables of a document by extension, in their order.
SIDECARS = ("csv", "xlsx")


def decoded(content: Column) -> Column:
    """struct(text, encoding, problem) of a file's bytes: UTF-8 if they are, else windows-1252; with a zero byte they are no text."""
    raw = content.cast("string")
    windows = F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _WINDOWS)

    def row(text: Column, encoding: str | None, problem: str | None = None) -> Column:
        return F.struct(text.alias("text"), F.lit(encoding).cast("string").alias("encoding"), F.lit(problem).cast("string").alias("problem"))

    return (
        F.when(F.contains(content, F.unhex(F.lit("00"))), row(F.lit(None).cast("string"), None, "binary"))
        .when(F.is_valid_utf8(raw), row(F.regexp_replace(raw, "^\\ufeff", ""), "utf-8"))
        .otherwise(row(windows, "windows-1252"))
    )


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _field(v: Column, name: str, kind: str) -> Column:
    """A field of a JSON value by its type, and where it came as a text or number of another type, what that can be cast to."""
    direct = F.try_variant_get(v, f"$.{name}", kind)
    return direct if kind == "string" or kind.startswith("array") else F.coalesce(direct, F.try_variant_get(v, f"$.{name}", "string").try_cast(kind))


def checked(records: DataFrame) -> DataFrame:
    """Adds the fields of ``FIELDS``, metadata and problem to ``records`` (with json, a text): problem is null, 'malformed', 'not an object' or 'missing ...'."""
    v, whole = F.col("_v"), F.col("_object")
    # What parses is an object if it begins as one: no schema is made of each record. Both are bound once, whatever asks for them.
    begins = F.startswith(F.ltrim(F.col("json"), F.lit(" \t\r\n")), F.lit("{"))
    parsed = records.withColumn("_v", F.try_parse_json("json")).withColumn("_object", v.isNotNull() & begins)
    fields = {name: F.when(whole, _field(v, name, kind)) for name, kind in FIELDS.items()}
    lacking = [F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in REQUIRED]
    problem = F.when(v.isNull(), "malformed").when(~whole, "not an object").otherwise(F.coalesce(*lacking))
    return parsed.withColumns(fields).withColumns({"metadata": F.when(whole, F.try_variant_get(v, "$.metadata", "map<string,string>")), "problem": problem}).drop("_v", "_object")


def read_object_lines(spark: SparkSession, path: str) -> DataFrame:
    """``checked`` objects of JSON lines with path and json; blank lines are skipped. A folder without files is empty."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
    return checked(lines.where(F.trim("json") != ""))


def read_object_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``checked`` objects of files that are one JSON array each; a file that is something else is one row, with a problem."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
    parsed = files.withColumn("_all", F.try_parse_json("json"))
    whole = _kind(F.col("_all")) == "ARRAY"
    items = parsed.where(whole).select("path", F.explode(F.transform(F.try_variant_get("_all", "$", "array<variant>"), lambda x: F.to_json(x))).alias("json"))
    other = checked(parsed.where(F.col("_all").isNull() | ~whole).select("path", "json")).withColumn("problem", F.coalesce("problem", F.lit("not an array")))
    return checked(items).unionByName(other)


def good(rows: DataFrame) -> DataFrame:
    return rows.where("problem is null").drop("problem", "json")


def problems(rows: DataFrame) -> DataFrame:
    """path, problem, json of what couldn't be read."""
    return rows.where("problem is not null").select("path", "problem", "json")


def first_source(first: DataFrame, second: DataFrame) -> DataFrame:
    """Good rows of each file_id from ``first``, and from ``second`` only for files of which the first has none."""
    bare = good(second).join(good(first).select("file_id").distinct(), "file_id", "left_anti")
    return good(first).unionByName(bare)


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """file_id (the folder's name), table_file, stem and place of the side tables below ``path``; their contents aren't read."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", kind.alias("kind")).where(F.col("kind").isin(*SIDECARS))
    named = files.select(
        F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("file_id"),
        F.col("path").alias("table_file"),
        F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1).alias("stem"),
        F.array_position(F.array(*map(F.lit, SIDECARS)), F.col("kind")).alias("rank"),
    )
    return named.withColumn("place", F.row_number().over(W.partitionBy("file_id").orderBy("rank", "table_file"))).drop("rank")


def with_sidecars(objects: DataFrame, tables: DataFrame) -> DataFrame:
    """``objects`` and, behind those of its file, one table object for each of ``sidecars``."""
    ends = objects.groupBy("file_id").agg(F.max("order_index").alias("_end"))
    made = tables.join(ends, "file_id", "left").select(
        F.concat(F.lit("table-"), "stem").alias("object_id"),
        "file_id",
        F.lit("table").alias("kind"),
        (F.coalesce("_end", F.lit(-1)) + F.col("place")).cast(objects.schema["order_index"].dataType).alias("order_index"),
        F.create_map(F.lit("table_file"), "table_file").alias("metadata"),
    )
    return objects.unionByName(made, allowMissingColumns=True)


def reasoning_text(payload: Column) -> Column:
    """What a model's reasoning says, from JSON: a text; of an object its content, text and message, lists item by item; of a list its texts and its objects' text or content."""
    v = F.try_parse_json(payload)

    def said(x: Column) -> Column:
        return F.try_variant_get(x, "$", "string")

    def part(name: str) -> Column:
        x = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(_kind(x) == "STRING", F.array(said(x))).when(_kind(x) == "ARRAY", F.transform(F.try_variant_get(x, "$", "array<variant>"), said)).otherwise(F.array().cast("array<string>"))

    def item(x: Column) -> Column:
        inner = F.coalesce(*(F.when(_kind(F.try_variant_get(x, f"$.{k}", "variant")) == "STRING", F.nullif(F.try_variant_get(x, f"$.{k}", "string"), F.lit(""))) for k in ("text", "content")))
        return F.when(_kind(x) == "STRING", said(x)).when(_kind(x) == "OBJECT", inner)

    by_kind = (
        F.when(_kind(v) == "STRING", F.array(said(v)))
        .when(_kind(v) == "OBJECT", F.concat(*(part(k) for k in ("content", "text", "message"))))
        .when(_kind(v) == "ARRAY", F.transform(F.try_variant_get(v, "$", "array<variant>"), item))
        .otherwise(F.array(said(v)))
    )
    return F.coalesce(F.array_join(F.array_compact(by_kind), "\n"), F.lit(""))
