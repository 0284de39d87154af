"""FASTA files as DataFrames, and what their headers say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def read(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq) of each record (S01): the file is split at '>' by the reader, so
    files may have any number of records. Reading a record stops at a line '#\\#'."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    body = F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n?(.*)$", 1), r"(?s)#\\#.*$", "")
    return rows.select(F.regexp_replace(F.regexp_extract("value", r"^([^\n]*)", 1), r"[\x00-\x1f]", "").alias("header"), F.regexp_replace(body, r"\s|[\x00-\x1f]", "").alias("seq"))


def write(df: DataFrame, path: str, header: str = "header", seq: str = "seq") -> None:
    """One record a row."""
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq))).write.text(path)


def locus_header(header, length) -> Column:
    """struct<chrom, abs_start, abs_end, strand> of 'chrom:start:end:strand' (S02):
    four fields, positive ends, strand 1 or -1; else unknown, 1, length, 1."""
    parts = F.split(_col(header), ":")
    safe = F.when(F.size(parts) == 4, parts).otherwise(F.array(*(F.lit("0"),) * 4))
    whole = lambda i: F.element_at(safe, i).try_cast("bigint")
    ok = F.coalesce((F.size(parts) == 4) & (whole(2) > 0) & (whole(3) > 0) & whole(4).isin(1, -1), F.lit(False))
    pick = lambda i, other: F.when(ok, whole(i)).otherwise(other)
    return F.struct(
        F.when(ok, F.element_at(safe, 1)).otherwise("unknown").alias("chrom"), pick(2, F.lit(1)).alias("abs_start"), pick(3, length).alias("abs_end"), pick(4, F.lit(1)).cast("int").alias("strand")
    )


def accession(header) -> Column:
    """The text after /gb= up to a space or '/' (S03); null if there is none."""
    return F.nullif(F.regexp_extract(_col(header), "/(?:gb|GB)=([^ /]+)", 1), F.lit(""))


def clone_end(header) -> Column:
    return F.nullif(F.regexp_extract(_col(header), "/clone_end=([^ /']+)", 1), F.lit(""))


def is_refseq(name) -> Column:
    return _col(name).rlike("^N[MR]_")


def strand(header) -> Column:
    """+1, or -1 for a 5' clone that isn't a RefSeq."""
    return F.when(is_refseq(F.coalesce(accession(header), F.lit(""))), 1).when(clone_end(header) == "5", -1).otherwise(1)


def fixed_strand(header) -> Column:
    flag = F.regexp_extract(_col(header), "/fixed_strand=([01])", 1)
    return is_refseq(F.coalesce(accession(header), F.lit(""))) | (clone_end(header).isin("3", "5") & (flag == "1"))


def transcripts(records: DataFrame) -> DataFrame:
    """est_id, gb, strand, fixed_strand, seq in genome direction; ``reason`` says why a
    record can't be used."""
    plus = F.col("strand") > 0
    named = records.select(F.col("header").alias("est_id"), accession("header").alias("gb"), clone_end("header").alias("clone_end"), strand("header").alias("strand"), F.coalesce(fixed_strand("header"), F.lit(False)).alias("fixed_strand"), "seq")
    reason = F.when(F.col("gb").isNull(), "no accession").when(F.col("seq") == "", "no sequence").when(F.col("seq").rlike("^N+$"), "only N")
    return named.withColumn("seq", F.when(plus, F.col("seq")).otherwise(reverse_complement("seq"))).withColumn("reason", reason)
