"""Seed matches of transcripts on a genome, and the graph of their pairings.

A pairing (p, t, l) is a common substring: 0-based starts in transcript and genome,
and its length; it can't be extended on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Bases of the transcript to a bin, in joins of pairings by their places; pairs of equal
#: k-mers of two texts that are held at once.
BIN, HITS = 64, 1 << 20


def _kmer_codes(text: np.ndarray, k: int) -> np.ndarray:
    """A number for the k symbols from each place on, equal for equal ones: those of shorter
    pieces are put together, and counted anew where they would grow too large."""
    codes, n = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while n < k:
        step = min(n, k - n)
        if (int(codes.max(initial=0)) + 1).bit_length() > 31:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        codes = codes[:-step] * (int(codes.max(initial=0)) + 1) + codes[step:]
        n += step
    return codes


def exact_matches(est: str, gen: str, k: int) -> np.ndarray:
    """Rows p, t and l of all common substrings of at least ``k`` symbols that can't be
    extended on either side; no match has a * or #. K-mers are sought in the genome's sorted
    ones, for HITS pairs at once; of these only those that begin or end a match are kept."""
    n, m = len(est), len(gen)
    if min(n, m) < k:
        return np.zeros((3, 0), np.int32)
    text = np.frombuffer((est + gen).encode("utf-32-le"), np.uint32)
    codes = _kmer_codes(text, k)
    masked = np.concatenate([[0], np.cumsum((text == ord("*")) | (text == ord("#")))])
    fine = masked[k:] == masked[:-k]
    # room for a place before the first and after the last one, where no k-mer is
    own, other = np.full(n - k + 3, -1), np.full(m - k + 3, -2)
    own[1:-1], other[1:-1] = np.where(fine, codes, -1)[: n - k + 1], np.where(fine, codes, -2)[n:]
    places = np.flatnonzero(other >= 0)
    places = places[np.argsort(other[places], kind="stable")]
    at = np.flatnonzero(own >= 0)
    low, high = (np.searchsorted(other[places], own[at], side) for side in ("left", "right"))
    found, low, at = (high - low)[high > low], low[high > low], at[high > low]
    before = np.concatenate([[0], np.cumsum(found)])
    firsts, lasts, i = [], [], 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(before, before[i] + HITS, "right")) - 1)
        p = np.repeat(at[i:j], found[i:j])
        t = places[np.repeat(low[i:j] - before[i:j], found[i:j]) + np.arange(before[i], before[j])]
        first, last = own[p - 1] != other[t - 1], own[p + 1] != other[t + 1]
        firsts.append(np.stack([t[first] - p[first], p[first]]))
        lasts.append(np.stack([t[last] - p[last], p[last]]))
        i = j
    if not firsts:
        return np.zeros((3, 0), np.int32)
    # on a diagonal the first and last k-mers of matches alternate
    (d, p), (_, q) = (x[:, np.lexsort((x[1], x[0]))] for x in (np.concatenate(firsts, 1), np.concatenate(lasts, 1)))
    return np.stack([p - 1, p + d - 1, q - p + k]).astype(np.int32)


def seed_matches(transcripts: DataFrame, genome: DataFrame, keys: Sequence[str], k: int, est: str = "est_id", gen: str = "gen_id", rate: float = 0.0) -> DataFrame:
    """Maximal exact matches of at least ``k`` (J01) of texts with equal keys. Only texts are
    shuffled; their k-mers never leave a task. With ``rate``, a match is kept if it has that
    share of the longest at its p. Both inputs have ``seq``."""

    @arrow_udf("array<struct<p: int, t: int, l: int>>")
    def matches(a: pa.Array, b: pa.Array) -> pa.Array:
        found = [exact_matches(x.as_py() or "", y.as_py() or "", k) for x, y in zip(a, b, strict=True)]
        every = np.concatenate([np.zeros((3, 0), np.int32), *found], 1)
        ends = np.cumsum([0, *(x.shape[1] for x in found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in every], names=["p", "t", "l"]))

    both = transcripts.select(*keys, est, F.col("seq").alias("_e")).join(genome.select(*keys, gen, F.col("seq").alias("_g")), list(keys))
    out = both.select(*keys, est, gen, F.explode(matches("_e", "_g")).alias("m")).select(*keys, est, gen, "m.*")
    if rate:
        longest = F.max("l").over(Window.partitionBy(*keys, est, gen, "p"))
        out = out.withColumn("_most", longest).filter(F.col("l") >= F.col("_most") * rate).drop("_most")
    return out


def drop_low_complexity(pairings: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pairings of repeats removed (W02): at one p, those inside an earlier one on the
    genome, or one base on with the same length; at the next p, those at the same t
    that are not longer."""
    other = pairings.select(*group, F.col("p").alias("op"), F.col("t").alias("ot"), F.col("l").alias("ol"))
    same_p = other.withColumn("p", F.col("op"))
    nested = ((F.col("ot") < F.col("t")) & (F.col("t") + F.col("l") <= F.col("ot") + F.col("ol"))) | ((F.col("t") == F.col("ot") + 1) & (F.col("l") == F.col("ol")))
    first = pairings.join(same_p, [*group, "p"]).filter(nested).select(*group, "p", "t", "l")
    next_p = other.withColumn("p", F.col("op") + 1).withColumn("t", F.col("ot"))
    second = pairings.join(next_p, [*group, "p", "t"]).filter(F.col("l") <= F.col("ol")).select(*group, "p", "t", "l")
    return pairings.join(first.unionByName(second).distinct(), [*group, "p", "t", "l"], "left_anti")


def edges(pairings: DataFrame, group: Sequence[str], least: int, max_intron: int = 0) -> DataFrame:
    """Pairs of pairings of one transcript that may follow each other (J02): the second
    starts after the first on both axes, nearly adjacent or overlapping a little on the
    transcript, and adjacent, apart, or overlapping a little on the genome."""
    fl = 2 * least + 1
    a = pairings.select(*group, *(F.col(c).alias(f"{c}1") for c in "ptl"))
    b = pairings.select(*group, *(F.col(c).alias(f"{c}2") for c in "ptl"))
    # the second starts after the first, and at most fl after its end: an equi-join on bins
    bins = lambda lo, hi: F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))
    a = a.withColumn("_bin", F.explode(bins(F.col("p1") + 1, F.col("p1") + F.col("l1") + fl)))
    b = b.withColumn("_bin", F.floor(F.col("p2") / BIN))
    p1, t1, l1, p2, t2, l2 = (F.col(c) for c in ("p1", "t1", "l1", "p2", "t2", "l2"))
    p_next = (p1 + l1 <= p2) & (p2 <= p1 + l1 + fl)
    p_over = (p1 + 2 * least <= p2 + l2) & (p2 < p1 + l1)
    t_next = t1 + l1 <= t2
    if max_intron:
        t_next = t_next & (t2 <= t1 + l1 + max_intron)
    t_over = (t1 + 2 * least <= t2 + l2) & (t2 < t1 + l1) & ((p2 - p1) - (t2 - t1) <= fl)
    loses = (l1 >= 5 * least) & (t1 + l1 - t2 > 0.4 * l1)
    fits = (p_next & (t_next | (t_over & ~loses))) | (~p_next & p_over & (t_next | t_over))
    return a.join(b, [*group, "_bin"]).filter((p2 > p1) & (t2 > t1) & fits).drop("_bin")


def ends(pairings: DataFrame, edge_rows: DataFrame, group: Sequence[str], rate: float = 0.6, length: str = "length") -> DataFrame:
    """Source and sink vertices (G01): within the first (last) ``rate`` of the
    transcript, and without a disjoint predecessor (successor). ``length`` is the
    transcript's; columns kind, p, t, l."""
    before = edge_rows.filter((F.col("p1") + F.col("l1") <= F.col("p2")) & (F.col("t1") + F.col("l1") <= F.col("t2")))
    has_before = before.select(*group, *(F.col(f"{c}2").alias(c) for c in "ptl")).distinct()
    has_after = before.select(*group, *(F.col(f"{c}1").alias(c) for c in "ptl")).distinct()
    on = [*group, "p", "t", "l"]
    source = pairings.filter(F.col("p") < F.col(length) * rate).join(has_before, on, "left_anti").select(*on).withColumn("kind", F.lit("source"))
    sink = pairings.filter(F.col("p") + F.col("l") > F.col(length) * (1 - rate)).join(has_after, on, "left_anti").select(*on).withColumn("kind", F.lit("sink"))
    return source.unionByName(sink)


def prune(edge_rows: DataFrame, fl: int = 31, min_intron: int = 40) -> DataFrame:
    """Edges whose gap on the genome is neither an alignment gap nor an intron go."""
    gap = F.col("t2") - F.col("t1") - F.col("l1") - (F.col("p2") - F.col("p1") - F.col("l1"))
    return edge_rows.filter(~((gap > fl + 2) & (gap < min_intron)))
