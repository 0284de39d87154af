"""Sequences, exon chains and intervals derived from the driver's tables, in Spark and
as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, seq: each document's ASCII letters as bases."""
    only = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.translate(only, LETTERS, BASES).alias("seq"))


SEQ = f"""seq AS (SELECT doc_id, source, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus, tid, ord, gen_start, gen_end, part: each order's lines as exons."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (10 * (1 + F.col("l_quantity").cast("int") % 5)).cast("bigint").alias("len"), (40 + 10 * (F.col("l_partkey") % 5)).cast("bigint").alias("gap")
    )
    start = 1 + F.coalesce(F.sum(F.col("len") + F.col("gap")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("ord", F.row_number().over(w)).withColumn("gen_start", start).select(
        (F.col("l_orderkey") % 50).alias("locus"), F.col("l_orderkey").alias("tid"), "ord", "gen_start", (F.col("gen_start") + F.col("len") - 1).alias("gen_end"), F.col("l_partkey").alias("part")
    )


CHAIN = """
lines AS (
  SELECT l_orderkey AS tid, l_orderkey % 50 AS locus, l_partkey AS part,
         row_number() OVER w AS ord,
         CAST(10 * (1 + CAST(l_quantity AS INTEGER) % 5) AS BIGINT) AS len, CAST(40 + 10 * (l_partkey % 5) AS BIGINT) AS gap
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
starts AS (SELECT *, CAST(1 + coalesce(sum(len + gap) OVER (PARTITION BY tid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gen_start FROM lines),
chain AS (SELECT locus, tid, CAST(ord AS INTEGER) AS ord, gen_start, gen_start + len - 1 AS gen_end, part FROM starts)"""

INTRONS = (
    CHAIN
    + """,
introns AS (
  SELECT * FROM (SELECT locus, tid, ord, part, gen_end + 1 AS i_start, lead(gen_start) OVER (PARTITION BY tid ORDER BY ord) - 1 AS i_end FROM chain) WHERE i_end IS NOT NULL)"""
)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, start, end: each event as an interval of seconds."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("bigint")
    long = F.coalesce(F.floor(F.col("value")), F.lit(0)).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "user_id", start.alias("start"), (start + F.abs(long)).alias("end"))


SPANS = "spans AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + abs(CAST(coalesce(floor(value), 0) AS BIGINT)) AS \"end\" FROM events)"
