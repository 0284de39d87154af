"""Exon chains: rows (key, tid, ord, gen_start, gen_end), one transcript per tid."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(tid: str) -> Window:
    return Window.partitionBy(tid).orderBy("ord")


def introns(chain: DataFrame, tid: str = "tid", virtual: bool = False) -> DataFrame:
    """The gaps between consecutive exons (W03): i_start, i_end, and ord of the exon
    before. With ``virtual`` also those before the first and after the last exon,
    whose outer ends are null."""
    after = F.lead("gen_start").over(_along(tid))
    inner = chain.withColumn("i_start", F.col("gen_end") + 1).withColumn("i_end", after - 1)
    if not virtual:
        return inner.filter("i_end IS NOT NULL").drop("gen_start", "gen_end")
    first = chain.withColumn("_first", F.lag("ord").over(_along(tid)).isNull()).filter("_first").drop("_first")
    start = first.withColumn("i_start", F.lit(None).cast("bigint")).withColumn("i_end", (F.col("gen_start") - 1).cast("bigint")).withColumn("ord", F.col("ord") - 1)
    return inner.drop("gen_start", "gen_end").unionByName(start.drop("gen_start", "gen_end"))


def intron_support(intron_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Support of each intron."""
    return intron_rows.groupBy(*keys, "i_start", "i_end").agg(F.count("*").alias("support"))


def support_list(intron_rows: DataFrame, keys: Sequence[str], tid: str = "tid") -> DataFrame:
    """Comma list of the transcripts of each intron, in order (A02). The list is the
    result's own column; it is as long as the support."""
    ids = F.array_sort(F.collect_list(F.col(tid)))
    return intron_rows.groupBy(*keys, "i_start", "i_end").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("supporting"))


def total_gap(chain: DataFrame, tid: str = "tid") -> DataFrame:
    """Bases between exons of each transcript."""
    gap = F.lead("gen_start").over(_along(tid)) - F.col("gen_end") - 1
    return chain.withColumn("_gap", gap).groupBy(tid).agg(F.coalesce(F.sum("_gap"), F.lit(0)).alias("gap"))


def cumulative(chain: DataFrame, tid: str = "tid") -> DataFrame:
    """Exon lengths added up along the transcript (W05): cum."""
    return chain.withColumn("cum", F.sum(F.col("gen_end") - F.col("gen_start") + 1).over(_along(tid).rowsBetween(Window.unboundedPreceding, 0)))


def frames(chain: DataFrame, tid: str = "tid") -> DataFrame:
    """Reading frame of each exon (W06), from the coding bases before it."""
    before = F.coalesce(F.sum(F.col("gen_end") - F.col("gen_start") + 1).over(_along(tid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chain.withColumn("frame", F.pmod(3 - F.pmod(before, F.lit(3)), F.lit(3)).cast("int"))


def summaries(chain: DataFrame, keys: Sequence[str], tid: str = "tid") -> DataFrame:
    """Exons, ends and covered bases of each transcript."""
    return chain.groupBy(*keys, tid).agg(
        F.count("*").alias("n_exons"), F.min("gen_start").alias("left_end"), F.max("gen_end").alias("right_end"), F.sum(F.col("gen_end") - F.col("gen_start") + 1).alias("covered")
    )


def is_monotone(chain: DataFrame, tid: str = "tid") -> DataFrame:
    """Whether starts and ends are in order, strictly along the chain."""
    before = F.lag("gen_end").over(_along(tid))
    fine = (F.col("gen_start") <= F.col("gen_end")) & F.coalesce(before < F.col("gen_start"), F.lit(True))
    return chain.withColumn("_fine", fine).groupBy(tid).agg(F.bool_and("_fine").alias("monotone"))


def shape(tid_cols: Sequence[str], chain: DataFrame) -> DataFrame:
    """The exon list of each transcript as one string (for P14, U04, C05)."""
    exons = F.array_sort(F.collect_list(F.struct("ord", "gen_start", "gen_end")))
    text = F.array_join(F.transform(exons, lambda e: F.concat_ws("-", e["gen_start"], e["gen_end"])), ",")
    return chain.groupBy(*tid_cols).agg(text.alias("exons"))


def distinct_chains(chain: DataFrame, keys: Sequence[str], tid: str = "tid") -> DataFrame:
    """The least transcript of each set with equal exons (P14), and how many it stands for."""
    return shape([*keys, tid], chain).groupBy(*keys, "exons").agg(F.min(tid).alias(tid), F.count("*").alias("copies"))


def without_tiny_exons(chain: DataFrame, tid: str = "tid", least: int = 3) -> DataFrame:
    """Transcripts all of whose exons have ``least`` bases."""
    tiny = chain.filter(F.col("gen_end") - F.col("gen_start") + 1 < least).select(tid).distinct()
    return chain.join(tiny, tid, "left_anti")


def best_segment(chain: DataFrame, bad: Column, tid: str = "tid") -> DataFrame:
    """The segment between bad exons with the most bases, the first of equals."""
    cut = chain.withColumn("_bad", bad.cast("int"))
    cut = cut.withColumn("_run", F.sum("_bad").over(_along(tid).rowsBetween(Window.unboundedPreceding, 0))).filter("_bad = 0")
    runs = cut.groupBy(tid, "_run").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.sum(F.col("gen_end") - F.col("gen_start") + 1).alias("bases"))
    best = F.max_by(F.struct("first_ord", "last_ord", "bases"), F.struct("bases", -F.col("first_ord")))
    return runs.groupBy(tid).agg(best.alias("_b")).select(tid, "_b.*")


def coverage_filter(alignments: DataFrame, group: str, coverage: str = "coverage", length: str = "length", least: float = 0.35, apart: float = 0.05, bases: float = 100) -> DataFrame:
    """Alignments with enough coverage, near the best of their transcript (P10)."""
    gap = F.max(coverage).over(Window.partitionBy(group)) - F.col(coverage)
    return alignments.withColumn("_gap", gap).filter((F.col(coverage) >= least) & (F.col("_gap") <= apart) & (F.col("_gap") * F.col(length) <= bases)).drop("_gap")


def gap_filter(alignments: DataFrame, group: str, gap: str = "gap", more: int = 20) -> DataFrame:
    """Alignments whose gaps are near the least of their transcript."""
    return alignments.withColumn("_least", F.min(gap).over(Window.partitionBy(group))).filter(F.col(gap) <= F.col("_least") + more).drop("_least")


def cap_alignments(alignments: DataFrame, group: str, most: int) -> DataFrame:
    """All alignments of a transcript, or none if they are more than ``most``; 0: no
    limit (O07)."""
    if not most:
        return alignments
    return alignments.withColumn("_n", F.count("*").over(Window.partitionBy(group))).filter(F.col("_n") <= most).drop("_n")


def best_alignment(alignments: DataFrame, group: str, ident: str, coverage: str = "coverage", exons: str = "n_exons") -> DataFrame:
    """Most coverage, then fewest exons, then first."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(coverage), exons, ident))
    return alignments.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def composition_key(chain: DataFrame, keys: Sequence[str], tid: str = "tid") -> DataFrame:
    """Inner splice sites, from the first exon's right end to the last one's left end
    (C01); a transcript of one exon has its own key."""
    exons = F.array_sort(F.collect_list(F.struct("ord", "gen_start", "gen_end")))
    sites = F.flatten(F.transform(exons, lambda e: F.array(e["gen_start"], e["gen_end"])))
    inner = F.array_join(F.transform(F.slice(sites, F.lit(2), F.greatest(F.size(sites) - 2, F.lit(0))), lambda x: x.cast("string")), ",")
    out = chain.groupBy(*keys, tid).agg(inner.alias("_inner"), F.count("*").alias("n_exons"), F.min("gen_start").alias("left_end"), F.max("gen_end").alias("right_end"))
    own = F.concat(F.lit("single:"), F.col(tid).cast("string"))
    return out.withColumn("site_key", F.when(F.col("n_exons") > 1, F.col("_inner")).otherwise(own)).drop("_inner")


def merge_compositions(compositions: DataFrame, keys: Sequence[str], tid: str = "tid") -> DataFrame:
    """Transcripts with one key made one: widest ends, support added up."""
    return compositions.groupBy(*keys, "site_key").agg(F.min(tid).alias(tid), F.max("n_exons").alias("n_exons"), F.min("left_end").alias("left_end"), F.max("right_end").alias("right_end"), F.count("*").alias("support"))


def fold_compositions(items: Sequence[tuple]) -> list[list]:
    """Compositions of one key joined in order (C02). An item is (order, polya, right,
    left, support, tid); it joins the first composition that its end allows: a poly-A end is
    fixed, so equal ends join, an end without poly-A joins one behind it, and a poly-A end one
    without poly-A before it, which it makes fixed. Returns (tid, left, right, polya, support)."""
    out: list[list] = []
    for _, polya, right, left, support, tid in items:
        for c in out:
            fits = (right == c[2] if c[3] else right >= c[2]) if polya else not c[3] or right <= c[2]
            if fits:
                c[1], c[2], c[3], c[4] = min(c[1], left), c[2] if c[3] else max(c[2], right), bool(c[3] or polya), c[4] + support
                break
        else:
            out.append([tid, left, right, bool(polya), support])
    return out


def merge_in_order(compositions: DataFrame, keys: Sequence[str], order: str = "tid", tid: str = "tid") -> DataFrame:
    """Transcripts with one key joined where their poly-A ends allow it (C02), in their
    order: keys, site_key, tid (the first one's), left_end, right_end, polya, support.
    ``compositions`` has keys, site_key, ``order``, left_end, right_end, polya and refseq;
    RefSeq ones stay apart. Transcripts of one key, end and flag join where the first of them
    did, whatever came in between (ends only move right until they are fixed), so they are
    added up before the rest is folded: a key has at most two items for each end."""
    own = F.when(F.col("refseq"), F.col(tid))
    items = compositions.withColumn("_own", own).groupBy(*keys, "site_key", "_own", "polya", "right_end").agg(F.min(F.struct(F.col(order).alias("order"), F.col(tid).alias("tid"))).alias("_first"), F.min("left_end").alias("left"), F.count("*").alias("support"))
    parts = items.groupBy(*keys, "site_key", "_own").agg(F.array_sort(F.collect_list(F.struct("_first.order", "polya", F.col("right_end").alias("right"), "left", "support", "_first.tid"))).alias("_items"))
    kind = compositions.schema[tid].dataType.simpleString()

    @F.pandas_udf(f"array<struct<tid: {kind}, left_end: bigint, right_end: bigint, polya: boolean, support: bigint>>")
    def fold(lists: pd.Series) -> pd.Series:
        names = ("tid", "left_end", "right_end", "polya", "support")
        return pd.Series([[dict(zip(names, c, strict=True)) for c in fold_compositions([tuple(x[k] for k in ("order", "polya", "right", "left", "support", "tid")) for x in items])] for items in lists])

    return parts.select(*keys, "site_key", F.explode(fold("_items")).alias("c")).select(*keys, "site_key", F.col("c.tid").alias(tid), "c.left_end", "c.right_end", "c.polya", "c.support")


def final_groups(chain: DataFrame, keys: Sequence[str], tid: str = "tid") -> DataFrame:
    """Transcripts with the same exons made one, their support added up; RefSeq ones (column
    ``refseq``) stay apart (C05): keys, exons, tid (the least), refseq, support."""
    rows = shape([*keys, tid, "refseq", "support"], chain)
    own = F.when(F.col("refseq"), F.col(tid))
    return rows.withColumn("_own", own).groupBy(*keys, "exons", "_own").agg(F.min(tid).alias(tid), F.first("refseq").alias("refseq"), F.sum("support").alias("support")).drop("_own")


def reduce_outer_exons(chain: DataFrame, keys: Sequence[str], tid: str = "tid") -> DataFrame:
    """First exons take the start of the widest internal exon with their end, last
    exons the end of the widest internal exon with their start (C04)."""
    w = Window.partitionBy(tid)
    marked = chain.withColumn("_lo", F.min("ord").over(w)).withColumn("_hi", F.max("ord").over(w))
    inner = marked.filter((F.col("ord") > F.col("_lo")) & (F.col("ord") < F.col("_hi")))
    by_end = inner.groupBy(*keys, "gen_end").agg(F.min("gen_start").alias("_wide_start"))
    by_start = inner.groupBy(*keys, "gen_start").agg(F.max("gen_end").alias("_wide_end"))
    out = marked.join(by_end, [*keys, "gen_end"], "left").join(by_start, [*keys, "gen_start"], "left")
    several = F.col("_lo") < F.col("_hi")
    start = F.when(several & (F.col("ord") == F.col("_lo")), F.coalesce("_wide_start", "gen_start")).otherwise(F.col("gen_start"))
    end = F.when(several & (F.col("ord") == F.col("_hi")), F.coalesce("_wide_end", "gen_end")).otherwise(F.col("gen_end"))
    return out.select(*keys, tid, "ord", start.alias("gen_start"), end.alias("gen_end"))


def exon_numbers(chain: DataFrame, keys: Sequence[str], identity: Sequence[str] = ()) -> DataFrame:
    """Distinct exons numbered by left and right end (W08, K04). With ``identity`` columns
    exons are told apart by these too: by their sequence (T01), or by the RefSeq transcript
    that keeps its own copy (C05)."""
    names = ["gen_start", "gen_end", *identity]
    distinct = chain.select(*keys, *names).distinct()
    return distinct.withColumn("exon_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*names)))


def covering_rows(chain: DataFrame, numbers: DataFrame, keys: Sequence[str], identity: Sequence[str] = ()) -> DataFrame:
    """The exon of the matrix that each exon of a chain is (T12): ``chain`` with exon_no, by
    ``exon_numbers`` of the same columns. Nulls of ``identity`` match nulls."""
    exact = [*keys, "gen_start", "gen_end"]
    right = numbers.select(*(F.col(c).alias(f"_n_{c}") for c in (*exact, *identity)), "exon_no")
    same = F.lit(True)
    for c in exact:
        same = same & (F.col(c) == F.col(f"_n_{c}"))
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    return chain.join(right, same).select(*chain.columns, "exon_no")


def isoform_numbers(isoforms: DataFrame, keys: Sequence[str], tid: str = "tid") -> DataFrame:
    """The reference first, then by exons, then as given."""
    order = Window.partitionBy(*keys).orderBy(F.desc("is_reference"), F.desc("n_exons"), tid)
    return isoforms.withColumn("isoform_no", F.row_number().over(order))
