"""Joins of isoforms, introns, exons and sites, and set operations on introns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import introns

#: Bases of a bin in joins of sites.
BIN = 64


def isoform_introns(isoforms: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Introns of isoforms (keys, tid, ord, gen_start, gen_end) with the columns of the
    reported introns (keys, i_start, i_end and more) that they are (J14)."""
    return introns(isoforms).join(known, [*keys, "i_start", "i_end"])


def supporting_exons(exons: DataFrame, tid: str = "tid") -> DataFrame:
    """For each intron of an alignment the exons beside it (J15): tid, i_start, i_end,
    left_ord and right_ord."""
    left = exons.select(tid, F.col("ord").alias("left_ord"), (F.col("gen_end") + 1).alias("i_start"))
    right = exons.select(tid, F.col("ord").alias("right_ord"), (F.col("gen_start") - 1).alias("i_end"))
    return introns(exons, tid).select(tid, "i_start", "i_end").join(left, [tid, "i_start"]).join(right, [tid, "i_end"]).select(tid, "i_start", "i_end", "left_ord", "right_ord")


def near_sites(rows: DataFrame, sites: DataFrame, keys: Sequence[str], at: str, most: int = 30) -> DataFrame:
    """Rows that have a site (keys, site) at most ``most`` bases from their column ``at``
    (J16): a semi-join on bins, so that a row has at most one place in each."""
    around = F.sequence(F.floor((F.col("site") - most) / BIN), F.floor((F.col("site") + most) / BIN))
    near = sites.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "site").distinct().withColumn("_site_bin", F.explode(around))
    on = (F.floor(F.col(at) / BIN) == F.col("_site_bin")) & (F.abs(F.col("site") - F.col(at)) <= most)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return rows.join(near, on, "left_semi")


def only_in_first(first: DataFrame, second: DataFrame, names: Sequence[str] = ("i_start", "i_end")) -> DataFrame:
    """Distinct introns of the first set that the second hasn't."""
    return first.select(*names).distinct().join(second.select(*names), list(names), "left_anti")


def in_both(first: DataFrame, second: DataFrame, names: Sequence[str] = ("i_start", "i_end")) -> DataFrame:
    """Distinct introns of both sets."""
    return first.select(*names).intersect(second.select(*names))
