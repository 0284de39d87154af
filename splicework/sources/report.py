"""Reports: intron tables, GTF lines and JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import lift

FEATURE_ORDER = ("exon", "5UTR", "start_codon", "CDS", "stop_codon", "3UTR")


def intron_table(introns: DataFrame, keys: Sequence[str], strand: Column, abs_start: Column, abs_end: Column, tid: str = "tid") -> DataFrame:
    """Introns with absolute ends, length, support and the supporting list."""
    ids = F.array_sort(F.collect_list(tid))
    rows = introns.groupBy(*keys, "i_start", "i_end").agg(F.count("*").alias("support"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("supporting"))
    at = lift(strand, abs_start, abs_end, "i_start", "i_end")
    return rows.select(*keys, "i_start", "i_end", at["start"].alias("abs_start"), at["end"].alias("abs_end"), (F.col("i_end") - F.col("i_start") + 1).alias("length"), "support", "supporting")


def gtf_lines(features: DataFrame, source: str = "splicework", keep: Sequence[str] = ()) -> DataFrame:
    """One GTF line for each feature (K09): chrom, feature, start, end, strand, frame,
    gene and isoform; ends in order whatever the strand."""
    quoted = lambda name, value: F.concat(F.lit(f'{name} "'), value, F.lit('";'))
    line = F.concat_ws(
        "\t",
        "chrom",
        F.lit(source),
        "feature",
        F.least("start", "end").cast("string"),
        F.greatest("start", "end").cast("string"),
        F.lit("."),
        F.when(F.col("strand") >= 0, "+").otherwise("-"),
        F.coalesce(F.col("frame").cast("string"), F.lit(".")),
        F.concat_ws(" ", quoted("gene_id", F.col("gene")), quoted("transcript_id", F.concat_ws(".", "gene", "isoform"))),
    )
    return features.select(*keep, line.alias("line"))


def write_gtf(features: DataFrame, path: str, compress: bool = False) -> None:
    """Sorted by chromosome, gene, isoform, start and feature order (K10: gzip)."""
    rank = F.array_position(F.array(*(F.lit(f) for f in FEATURE_ORDER)), F.col("feature"))
    ordered = features.orderBy("chrom", "gene", "isoform", F.least("start", "end"), rank)
    gtf_lines(ordered).write.option("compression", "gzip" if compress else "none").text(path)


def intron_json(introns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A JSON document of each key's introns, in order."""
    one = F.struct("i_start", "i_end", "support")
    ordered = F.transform(
        F.array_sort(F.collect_list(one)),
        lambda i: F.struct(i["i_start"].alias("relative_start"), i["i_end"].alias("relative_end"), i["support"].alias("number_of_supporting_transcripts")),
    )
    return introns.groupBy(*keys).agg(F.to_json(F.struct(F.lit(5).alias("file_format_version"), ordered.alias("introns"))).alias("document"))


def by_least_exons(isoforms: DataFrame, levels: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Each isoform once for every least number of exons that it has (K06); write it
    with partitionBy("least_exons")."""
    return isoforms.withColumn("least_exons", F.explode(F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k <= F.col("n_exons"))))
