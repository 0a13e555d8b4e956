"""A corpus of specification documents derived from orders: a file for each order, a section for each of its lines.

The driver's documents hold none of what specification documents do; this one has requirements, units, bullets, enumerators,
tables of contents and repeated footers, by a rule that any SQL engine can state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is told of a line, of a section ``l``, its part ``p`` and the line's index ``k``.
TOLD = """
SELECT concat('order-', l.l_orderkey) AS file_id, concat('sec-', l.l_linenumber) AS section_id,
  CAST(l.l_linenumber AS INT) AS section_no, k.k AS line_idx, CAST((l.l_linenumber - 1) * 4 + k.k AS INT) AS ord,
  CASE (l.l_orderkey + l.l_linenumber * 3 + k.k) % 14
    WHEN 0 THEN concat('- ', p.p_name, ' shall be ', p.p_size, ' mm wide')
    WHEN 1 THEN concat('Supply voltage must be ', p.p_size, ' VDC')
    WHEN 2 THEN concat(l.l_linenumber, '.', k.k, ' ', p.p_name, ' ......... ', p.p_size)
    WHEN 3 THEN concat('Controller firmware should be version ', p.p_size)
    WHEN 4 THEN concat('Ambient limit ', p.p_size, ' °F in service')
    WHEN 5 THEN 'General description without a requirement'
    WHEN 6 THEN concat('* Operator training is required within ', p.p_size, ' days')
    WHEN 7 THEN concat('Motor speed ', p.p_size, ' rpm at ', l.l_linenumber, ' bar')
    WHEN 8 THEN 'Company Confidential'
    WHEN 9 THEN concat(l.l_linenumber, ') Provide ', p.p_brand, ' spare parts')
    WHEN 10 THEN concat(l.l_linenumber, ' SECTION FOR ', upper(p.p_brand))
    WHEN 11 THEN concat('IV.', k.k, ' Weight of ', p.p_size, ' kg per ISO ', 9000 + p.p_size)
    WHEN 12 THEN 'Table of Contents'
    ELSE concat('Appendix ', chr(CAST(65 + l.l_linenumber AS INT)), ' Feeder rated ', p.p_size, ' kV') END AS line
"""
FILE = "concat('order-', l.l_orderkey)"
#: SQL that Spark and others run alike.
SQL = (
    TOLD
    + """FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k ON k.k <= 3
"""
)


def spec_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, section_id, section_no, line_idx, ord, line: every line of every document; ``SQL``'s rows.

    Sections meet by their document before they are told line by line: what works on whole documents needs no exchange of lines. A line is bound by a
    generator: each pattern asked of it would else make it anew from its fourteen cases.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).alias("l")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").alias("p")
    sections = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.expr(FILE).alias("file_id"), "l_orderkey", "l_linenumber", "p_name", "p_size", "p_brand")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by a number of its own: sections are small, their lines aren't
    each = sections.repartition(n, "file_id").select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    told = TOLD.replace(FILE, "file_id").replace("l.l_", "l_").replace("p.p_", "p_").replace("k.k", "k")
    made = spark.sql(told + "FROM {each}", each=each)
    return made.select("file_id", "section_id", "section_no", "line_idx", "ord", F.explode(F.array("line")).alias("line"))


def oracle() -> str:
    return SQL.format(lineitem="lineitem", part="part")
