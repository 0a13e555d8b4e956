"""Writers of tables for interchange: JSON lines, CSV, tab-separated reports, and comparison with a recorded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redacted


def write_table(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet in folders by ``keys`` (file ids, say)."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_traces(rows: DataFrame, path: str) -> None:
    """Debug traces as JSON lines, a folder for each document; secrets in their values are hidden, long ones cut."""
    shown = [redacted(F.lit(c), F.col(c)).alias(c) if kind == "string" and c != "file_id" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*shown).write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("file_id").json(path)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").option("header", "true").option("sep", separator).option("escape", '"').csv(path)


def header_report(headers: DataFrame) -> DataFrame:
    """Rows of the header search report, white space collapsed: a tab-separated table of five columns."""
    columns = ("section_number", "section_name", "page_number", "line_number", "chunk_text")
    return headers.select(*(F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " ")).alias(c) for c in columns))


def differences(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows in one table only, repeats counted, with ``side``: '+' in ``now``, '-' in ``recorded``."""
    plus, minus = now.exceptAll(recorded), recorded.exceptAll(now)
    return plus.withColumn("side", F.lit("+")).unionByName(minus.withColumn("side", F.lit("-")))


def write_vectors(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").parquet(path)


def read_vectors(spark, path: str, dimension: int) -> DataFrame:
    """Persisted vectors; rows of another dimension are skipped."""
    return spark.read.parquet(path).where(F.size("vector") == dimension)


def stage_done(spark, path: str) -> bool:
    """Whether a stage's table is there whole: its success mark."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resumed(spark, path: str, make, rebuild: bool = False) -> DataFrame:
    """The table at ``path``, made by ``make()`` unless a former run has."""
    if rebuild or not stage_done(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
