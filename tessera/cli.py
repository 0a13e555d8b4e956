"""Commands over files: extract specification items, search them, list headers.

    python -m tessera.cli specs PATH --out FOLDER
    python -m tessera.cli headers PATH --out FOLDER
    python -m tessera.cli search PATH QUERY [--top K]

PATH holds .txt and .docx files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import atomize, headers, lines, search
from .sources import files, sinks


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_id, ord, line of all files that can be read."""
    found = files.binary(spark, path).where("problem is null")
    objects = files.text_objects(found.where("extension = 'txt'"), keep_blank=False).unionByName(files.docx_objects(found.where("extension = 'docx'")))
    return lines.object_lines(objects).select("file_id", F.col("line_no").alias("ord"), F.col("entry").alias("line"))


def sectioned(rows: DataFrame) -> DataFrame:
    """Adds section_id: the latest header's place, or the root before the first."""
    heads = headers.rule_headers(rows).select("file_id", "ord", "position")
    so_far = F.max("position").over(W.partitionBy("file_id").orderBy("ord"))
    place = F.format_string("%s-sec-%04d", F.col("file_id"), F.col("at"))
    return rows.join(heads, ["file_id", "ord"], "left").withColumn("at", so_far).withColumn(
        "section_id", F.when(F.col("at").isNull(), F.concat("file_id", F.lit("-root"))).otherwise(place)
    ).drop("at", "position")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("specs", "headers", "search"))
    parser.add_argument("path")
    parser.add_argument("query", nargs="?", default="")
    parser.add_argument("--out")
    parser.add_argument("--top", type=int, default=5)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    rows = document_lines(spark, a.path)
    if a.command == "headers":
        made = headers.section_tree(headers.leveled(headers.rule_headers(rows)))
    else:
        made = atomize.atomize(sectioned(rows))
    if a.command == "search":
        docs = made.select(F.col("spec_id").alias("doc_id"), F.col("spec_text").alias("text")).distinct()
        made = search.hybrid(docs, spark.createDataFrame([(0, a.query)], "query_id int, text string"), a.top).join(docs, "doc_id").orderBy("rank")
    if a.out:
        sinks.write_jsonl(made, a.out)
    else:
        made.show(a.top if a.command == "search" else 20, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
