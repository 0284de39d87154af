"""Coding regions and splicing events of isoforms.

Chains are rows (key, tid, ord, gen_start, gen_end) in ascending coordinates, exons
numbered from 1; positions on a transcript are 1-based, from its 5' end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import STOPS


def longest_orf(rows: DataFrame, ids: Sequence[str], least: int = 100, context: bool = True, seq: str = "seq") -> DataFrame:
    """orf_start, orf_end and protein_length of the longest frame from ATG to a stop, of
    ``least`` bases (T07). With ``context``, starts with a Kozak context come first; of
    equal ones the first. Each start finds its stop by a search among its frame's."""
    codes = {c: sum(ord(x) << (8 * k) for k, x in enumerate(c)) for c in ("ATG", *STOPS)}

    @F.pandas_udf("orf_start int, orf_end int, protein_length int")
    def found(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            c = np.frombuffer((t or "").upper().encode("ascii", "replace"), np.uint8).astype(np.int32)
            codon = c[:-2] | c[1:-1] << 8 | c[2:] << 16 if len(c) > 2 else c[:0]
            stop = np.flatnonzero(np.isin(codon, [codes[x] for x in STOPS]))
            best = (None, None, None)
            start, end = [], []
            for frame in range(3):
                s = np.flatnonzero(codon[frame::3] == codes["ATG"]) * 3 + frame
                e = stop[stop % 3 == frame]
                at = np.searchsorted(e, s)
                start.append(s[at < len(e)])
                end.append(e[at[at < len(e)]])
            s, e = np.concatenate(start), np.concatenate(end)
            keep = e + 3 - s >= least
            s, e = s[keep], e[keep]
            if len(s):
                good = np.ones(len(s), np.int64)
                if context:
                    side = lambda at: np.where((at >= 0) & (at < len(c)), np.isin(c[np.clip(at, 0, len(c) - 1)], (65, 71)), False)  # noqa: B023, E731
                    good = (side(s - 3) | side(s + 3)).astype(np.int64)
                k = np.lexsort((s, s - e, -good))[0]
                best = (int(s[k]) + 1, int(e[k]) + 3, int(e[k] - s[k]) // 3)
            out.append(best)
        return pd.DataFrame(out, columns=["orf_start", "orf_end", "protein_length"]).astype("Int32")

    return rows.select(*ids, found(F.col(seq)).alias("_o")).select(*ids, "_o.*").filter("orf_start IS NOT NULL")


def lengths(chain: DataFrame) -> DataFrame:
    """``chain`` with each exon's first and last base on the transcript: lo, hi."""
    n = F.col("gen_end") - F.col("gen_start") + 1
    w = Window.partitionBy("tid").orderBy("ord")
    hi = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return chain.withColumn("hi", hi).withColumn("lo", F.col("hi") - n + 1).withColumn("total", F.sum(n).over(Window.partitionBy("tid")))


def place(chain: DataFrame, orf: DataFrame, strand: int = 1) -> DataFrame:
    """Where an ORF (tid, orf_start, orf_end) starts and ends on the genome (T08):
    start_ord, end_ord, gen_orf_left, gen_orf_right."""
    placed = lengths(chain).join(orf, "tid")
    first = F.col("orf_start") if strand > 0 else F.col("total") - F.col("orf_end") + 1
    last = F.col("orf_end") if strand > 0 else F.col("total") - F.col("orf_start") + 1
    here = lambda p: F.when((F.col("lo") <= p) & (p <= F.col("hi")), F.col("gen_start") + p - F.col("lo"))
    number = lambda p: F.when((F.col("lo") <= p) & (p <= F.col("hi")), F.col("ord"))
    return placed.groupBy("tid").agg(F.max(number(first)).alias("left_ord"), F.max(number(last)).alias("right_ord"), F.max(here(first)).alias("gen_left"), F.max(here(last)).alias("gen_right"))


def utr_lengths(chain: DataFrame, orf: DataFrame) -> DataFrame:
    """5' and 3' untranslated bases (T18); -1 without an ORF."""
    total = chain.groupBy("tid").agg(F.sum(F.col("gen_end") - F.col("gen_start") + 1).alias("total"))
    out = total.join(orf, "tid", "left")
    return out.select("tid", F.coalesce(F.col("orf_start") - 1, F.lit(-1)).alias("utr5"), F.coalesce(F.col("total") - F.col("orf_end"), F.lit(-1)).alias("utr3"))


def nmd(chain: DataFrame, orf: DataFrame, most: int = 50) -> DataFrame:
    """Nonsense-mediated decay (T17): -1 without an ORF, 1 if the stop isn't in the last
    exon and is more than ``most`` bases from its exon's end, else 0."""
    placed = lengths(chain).join(orf, "tid", "left")
    last = F.max("ord").over(Window.partitionBy("tid"))
    at = (F.col("lo") <= F.col("orf_end")) & (F.col("orf_end") <= F.col("hi"))
    early = at & (F.col("ord") < F.col("_last")) & (F.col("hi") - F.col("orf_end") > most)
    return placed.withColumn("_last", last).groupBy("tid").agg(F.when(F.max("orf_end").isNull(), -1).when(F.coalesce(F.bool_or(early), F.lit(False)), 1).otherwise(0).alias("nmd"))


def regions(chain: DataFrame, orf: DataFrame, strand: int = 1) -> DataFrame:
    """Features of each exon (T19): 5UTR, start_codon, CDS, stop_codon and 3UTR with
    genome coordinates. CDS has no stop codon; codons may be split over exons."""
    placed = lengths(chain).join(orf, "tid")
    if strand < 0:  # count from the other end
        flip = lambda c: F.col("total") - F.col(c) + 1
        placed = placed.withColumn("_l", flip("hi")).withColumn("_h", flip("lo")).drop("lo", "hi").withColumnsRenamed({"_l": "lo", "_h": "hi"})
    s, e, n = F.col("orf_start"), F.col("orf_end"), F.col("total")
    named = [("5UTR", F.lit(1), s - 1), ("start_codon", s, s + 2), ("CDS", s, e - 3), ("stop_codon", e - 2, e), ("3UTR", e + 1, n)]
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b")) for k, a, b in named)))
    cut = placed.withColumn("_f", parts).select("*", "_f.*").withColumn("a", F.greatest("a", "lo")).withColumn("b", F.least("b", "hi")).filter("a <= b")
    if strand > 0:
        left, right = F.col("gen_start") + F.col("a") - F.col("lo"), F.col("gen_start") + F.col("b") - F.col("lo")
    else:
        left, right = F.col("gen_end") - (F.col("b") - F.col("lo")), F.col("gen_end") - (F.col("a") - F.col("lo"))
    return cut.select("tid", "ord", "feature", left.alias("start"), right.alias("end"))


def location(start: Column, end: Column, cds_left: Column, cds_right: Column) -> Column:
    """Where an interval lies (T11): 5UTR, CDS, 3UTR and crossings, on the + strand."""
    of = lambda p: F.when(p < cds_left, 0).when(p <= cds_right, 1).otherwise(2)
    a, b = of(start), of(end)
    return F.when(a == b, F.when(a == 0, "5UTR").when(a == 1, "CDS").otherwise("3UTR")).when((a == 0) & (b == 1), "5UTR_CDS").when((a == 1) & (b == 2), "CDS_3UTR").otherwise("5UTR_3UTR")


def reference(isoforms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The reference isoform of each key (T09): with an ORF first; RefSeq by exons
    times bottleneck support, then type 1, then any; more exons, longer, first."""
    has = F.coalesce(F.col("has_orf"), F.lit(False))
    score = F.when(F.col("is_refseq"), F.col("n_exons") * F.col("bottleneck")).otherwise(0)
    order = Window.partitionBy(*keys).orderBy(F.desc(has), F.desc("is_refseq"), F.desc(score), F.desc("type_one"), F.desc("n_exons"), F.desc("length"), "tid")
    return isoforms.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def isoform_type(chain_introns: DataFrame, typed: DataFrame, keys: Sequence[str], every: bool = False) -> DataFrame:
    """Type of each isoform, from its first intron's type, or all."""
    rows = chain_introns.join(typed, [*keys, "i_start", "i_end"])
    least = F.max("intron_type") if every else F.min_by("intron_type", "ord")
    return rows.groupBy(*keys, "tid").agg(least.alias("isoform_type"))


def intron_type(refseq: Column, support: Column) -> Column:
    """0 RefSeq, 1 with more than one support, 2 else."""
    return F.when(refseq, 0).when(support > 1, 1).otherwise(2)


def _exons(chain: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    last = F.max("ord").over(Window.partitionBy("tid"))
    return chain.select(*keys, F.col("tid").alias(f"tid{suffix}"), F.col("ord").alias(f"ord{suffix}"), F.col("gen_start").alias(f"s{suffix}"), F.col("gen_end").alias(f"e{suffix}"), last.alias(f"n{suffix}"))


def _over(left: DataFrame, own: tuple[str, str], right: DataFrame, other: tuple[str, str], keys: Sequence[str], width: int = 1024) -> DataFrame:
    """Rows of equal keys whose spans overlap, joined by bins of coordinates."""
    from .intervals import overlap_join

    a = left.withColumn("_s", F.col(own[0])).withColumn("_e", F.col(own[1]))
    b = right.withColumn("r_start", F.col(other[0])).withColumn("r_end", F.col(other[1]))
    return overlap_join(a, b, keys, F.lit(True), width, ("_s", "_e")).drop("_s", "_e", "r_start", "r_end")


def competing_sites(chain: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A5E and A3E (T14): an exon shares one end with a reference exon, and the other
    end, a splice site in both, differs. tid, ord, r_ord, event, shift."""
    a, b = _exons(chain, keys, ""), _exons(refs, keys, "_r")
    at = lambda x: a.withColumn("_x", F.col(x)).join(b.withColumn("_x", F.col(f"{x}_r")), [*keys, "_x"])
    five = at("s").filter("e != e_r AND ord < n AND ord_r < n_r").withColumn("event", F.lit("A5E")).withColumn("shift", F.col("e") - F.col("e_r"))
    three = at("e").filter("s != s_r AND ord > 1 AND ord_r > 1").withColumn("event", F.lit("A3E")).withColumn("shift", F.col("s_r") - F.col("s"))
    return five.unionByName(three).filter("tid != tid_r").select(*keys, "tid", "ord", F.col("ord_r"), "event", "shift")


def retained(chain: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IR+ and IR- (T15): an exon that spans a reference intron, and a reference exon
    that spans an intron of the isoform. tid, event, i_start, i_end."""
    from .chains import introns

    ref_introns = introns(refs).select(*keys, "i_start", "i_end", F.col("tid").alias("tid_r"))
    plus = _over(chain, ("gen_start", "gen_end"), ref_introns, ("i_start", "i_end"), keys).filter("gen_start < i_start AND i_end < gen_end AND tid != tid_r").select(*keys, "tid", F.lit("IR+").alias("event"), "i_start", "i_end")
    own = introns(chain).select(*keys, "tid", "i_start", "i_end")
    span = refs.select(*keys, F.col("tid").alias("tid_r"), "gen_start", "gen_end")
    minus = _over(own, ("i_start", "i_end"), span, ("gen_start", "gen_end"), keys).filter("gen_start < i_start AND i_end < gen_end AND tid != tid_r").select(*keys, "tid", F.lit("IR-").alias("event"), "i_start", "i_end")
    return plus.unionByName(minus).distinct()


def skipped(chain: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Skipped reference exons and new exons (T16): an exon of one that lies inside an
    intron of the other. tid, event, start, end."""
    from .chains import introns

    own = introns(chain).select(*keys, "tid", "i_start", "i_end")
    ref_exons = refs.select(*keys, F.col("tid").alias("tid_r"), F.col("gen_start").alias("start"), F.col("gen_end").alias("end"))
    skip = _over(own, ("i_start", "i_end"), ref_exons, ("start", "end"), keys).filter("i_start <= start AND end <= i_end AND tid != tid_r").select(*keys, "tid", F.lit("skip").alias("event"), "start", "end")
    ref_introns = introns(refs).select(*keys, F.col("tid").alias("tid_r"), "i_start", "i_end")
    exons = chain.select(*keys, "tid", F.col("gen_start").alias("start"), F.col("gen_end").alias("end"))
    new = _over(exons, ("start", "end"), ref_introns, ("i_start", "i_end"), keys).filter("i_start <= start AND end <= i_end AND tid != tid_r").select(*keys, "tid", F.lit("new").alias("event"), "start", "end")
    return skip.unionByName(new).distinct()


def outer_changes(chain: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """init and term (T16): the first (last) exon isn't the reference's. One row per
    transcript of a key that has a reference."""
    ends = lambda df: df.groupBy(*keys, "tid").agg(F.min_by(F.struct("gen_start", "gen_end"), "ord").alias("first"), F.max_by(F.struct("gen_start", "gen_end"), "ord").alias("last"))
    r = ends(refs).select(*keys, F.col("first").alias("first_r"), F.col("last").alias("last_r"))
    return ends(chain).join(r, list(keys)).select(*keys, "tid", (F.col("first") != F.col("first_r")).alias("init"), (F.col("last") != F.col("last_r")).alias("term"))


def in_frame(chain: DataFrame, orfs: DataFrame, refs: DataFrame, ref_orfs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether coding bases that an isoform shares with its reference are read in one
    frame in every overlap, and are half of its own at least (T13)."""

    def coding(c: DataFrame, o: DataFrame) -> DataFrame:
        placed = lengths(c).join(o, "tid")
        a, b = F.greatest("lo", "orf_start"), F.least("hi", "orf_end")
        return placed.filter(a <= b).select(*keys, "tid", (F.col("gen_start") + a - F.col("lo")).alias("a"), (F.col("gen_start") + b - F.col("lo")).alias("b"), F.pmod(a - F.col("orf_start") - (F.col("gen_start") + a - F.col("lo")), F.lit(3)).alias("phase"))

    mine, theirs = coding(chain, orfs), coding(refs, ref_orfs)
    own = mine.groupBy(*keys, "tid").agg(F.sum(F.col("b") - F.col("a") + 1).alias("coding"))
    other = theirs.select(*keys, F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("phase").alias("rphase"))
    both = _over(mine, ("a", "b"), other, ("ra", "rb"), keys)
    shared = both.groupBy(*keys, "tid").agg(F.sum(F.least("b", "rb") - F.greatest("a", "ra") + 1).alias("shared"), F.bool_and(F.col("phase") == F.col("rphase")).alias("same"))
    out = own.join(shared, [*keys, "tid"], "left")
    # whole percent, as integers divide
    return out.select(*keys, "tid", F.coalesce(F.col("same") & (F.floor(F.col("shared") * 100 / F.col("coding")) >= 50), F.lit(False)).alias("in_frame"))
