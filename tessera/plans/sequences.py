"""Plans for what is sequential by nature: folds over a document's rows, and places in a global order."""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import likeness


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, from 1, in the global order: ranks in ranges, and how many rows the ranges before hold.

    The ranges' boundaries are sampled: the ranged rows are persisted, so that both uses see the same ones. A lost part is made
    again by the same exchange, with the same boundaries.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn("place", (F.col("_local") + F.col("_before")).cast("int")).drop("_part", "_local", "_before", "_n")


def anchored(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, position, anchor: the first line from after the last anchor that is a prefix of the title or has it as one.

    A fold over a document's headers; the lines of one document are its state.
    """
    body = lines.select("file_id", "ord", T.match_key(F.col("line")).alias("l")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "l"))).alias("lines"))
    heads = headers.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("position", T.match_key(F.col("section_name")).alias("t")))).alias("heads"))

    def step(state, head):
        fits = lambda x: (x["ord"] >= state["next"]) & (x["l"] != "") & (head["t"] != "") & (x["l"].startswith(head["t"]) | head["t"].startswith(x["l"]))
        at = F.get(F.filter("lines", fits), F.lit(0))["ord"]
        row = F.struct(head["position"].alias("position"), at.alias("anchor"))
        return F.struct(F.coalesce(at + 1, state["next"]).alias("next"), F.array_append(state["out"], row).alias("out"))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<position:int,anchor:int>>").alias("out"))
    return heads.join(body, "file_id").select("file_id", F.inline(F.aggregate("heads", start, step, lambda s: s["out"])))


def depths(lines: list[str]) -> list[tuple[int, str, str]]:
    """(depth, number, title) of a nested list's lines: two spaces a level, at most one deeper than the last; dots of a number deepen."""
    out, last = [], 0
    for raw in lines:
        line = raw.replace("\t", "    ").rstrip()
        body = line.strip()
        token, _, rest = body.partition(" ")
        bare = token.strip("()").rstrip(".")
        listed = bool(rest.strip()) and bare.replace(".", "").isalnum()
        number, title = (token, rest.strip()) if listed else ("", body)
        if not title:
            continue
        depth = max(min((len(line) - len(line.lstrip(" "))) // 2, last + 1), number.rstrip(".)").count("."))
        last = depth
        out.append((depth, number, title))
    return out


def nested(blocks: DataFrame) -> DataFrame:
    """file_id, at, depth, number, title of each block's list lines: a document is a group."""

    def run(batches):
        for pdf in batches:
            rows = [(f, i, *row) for f, b in zip(pdf["file_id"], pdf["block"], strict=True) for i, row in enumerate(depths([x for x in b.splitlines() if not x.startswith("#headers#")]))]
            yield pd.DataFrame(rows, columns=["file_id", "at", "depth", "number", "title"])

    return blocks.select("file_id", "block").mapInPandas(run, "file_id string, at int, depth int, number string, title string")


def closest(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, position, ord, ratio: the line of the document most alike the header's name, the greatest of equals, at its first place."""
    names = headers.select("file_id", "position", F.col("section_name").alias("name"))
    return likeness.closest(names, lines).select("file_id", "position", "ord", F.round("ratio", 6).alias("ratio"))
