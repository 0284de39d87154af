"""Small exons: false ones are joined with their neighbours (P16), and ones that are too
small for a seed are looked for in introns (P17).

Alignments have ids, ``exons`` (an array of est_start, est_end, gen_start, gen_end, 1-based)
and the texts. Both rules go through an alignment from left to right, and what they change
counts for what follows: in each round, of every alignment that isn't through, the first
place is changed where the rule applies, so rounds are as many as one alignment has
changes. Only texts around borders, and introns that are searched, go to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.sequence import pattern_frequency
from ..session import cut_lineage
from . import align

#: Lengths of small exons, the length up to which exons may be false, bases of neighbours that
#: are split anew, bases of a border without errors, and edits that a good border may have.
SMALLEST, LARGEST, FALSE, AFFIX, PERFECT, GOOD = 6, 23, 100, 5, 6, 2
_EXONS = "array<struct<est_start: bigint, est_end: bigint, gen_start: bigint, gen_end: bigint>>"


def _piece(text: str, start: Column, n: Column) -> Column:
    """``n`` bases from ``start`` on; what lies before the text is left out."""
    first = F.greatest(start, F.lit(1))
    return F.substring(text, first.cast("int"), F.greatest(start + n - first, F.lit(0)).cast("int"))


def _struct(e: Column, **new: Column) -> Column:
    return F.struct(*(new.get(c, e[c]).cast("bigint").alias(c) for c in ("est_start", "est_end", "gen_start", "gen_end")))


def _rounds(alignments: DataFrame, ids: Sequence[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` gets the open alignments (with ``_from``, the place from which on they are
    looked at) and returns ids, ``_new`` exons and ``_next`` of those that it changed."""
    now = alignments.withColumn("exons", F.col("exons").cast(_EXONS)).withColumn("_from", F.lit(0).cast("bigint"))
    done = None
    while True:
        changed = step(now)
        both = cut_lineage(now.join(changed, list(ids), "left"))
        still = both.filter("_new IS NULL").select(*alignments.columns)
        done = still if done is None else done.unionByName(still)
        now = both.filter("_new IS NOT NULL").select(*(F.col("_new").alias("exons") if c == "exons" else c for c in alignments.columns), F.col("_next").alias("_from"))
        if now.isEmpty():
            return done


def _frequency_at(gen: str, first: Column, after: Column) -> Column:
    """The pattern's frequency of the intron from ``first`` to before ``after``."""
    return F.when(after >= 3, pattern_frequency(F.substring(gen, first.cast("int"), F.lit(2)), F.substring(gen, (after - 2).cast("int"), F.lit(2)))).otherwise(0)


def without_false(alignments: DataFrame, ids: Sequence[str], est: str = "est", gen: str = "genome") -> DataFrame:
    """Inner exons of up to FALSE bases go (P16) where they and up to AFFIX bases of both
    neighbours can be split between the neighbours (F17) with no more edits, and the new
    intron's pattern is at least as frequent as the mean of both old ones'. Beside the
    exon's own edits and the left neighbour's, those of as many bases before it as the right
    neighbour gives are allowed for."""

    def step(now: DataFrame) -> DataFrame:
        inner = now.filter(F.size("exons") > 2).select(*ids, est, gen, "exons", "_from", F.explode(F.sequence(F.lit(2), F.size("exons") - 1)).alias("i"))
        inner = inner.select(*ids, est, gen, "_from", "i", *(F.element_at("exons", F.col("i") + k).alias(n) for n, k in (("a", -1), ("b", 0), ("c", 1))))
        n_est, n_gen = F.col("b.est_end") - F.col("b.est_start") + 1, F.col("b.gen_end") - F.col("b.gen_start") + 1
        start = {x: F.greatest(F.col(f"a.{x}_start") + 1, F.col(f"a.{x}_end") + 1 - AFFIX) for x in ("est", "gen")}
        # one past the last base of the right neighbour that takes part
        end = {x: F.least(F.col(f"c.{x}_end"), F.col(f"c.{x}_start") + AFFIX) for x in ("est", "gen")}
        head = {x: F.col(f"a.{x}_end") + 1 - start[x] for x in start}
        tail = {x: end[x] - F.col(f"c.{x}_start") for x in start}
        rows = inner.filter((n_est <= FALSE) & (F.col("i") >= F.col("_from")))
        cost = F.levenshtein(_piece(est, F.col("b.est_start"), n_est), _piece(gen, F.col("b.gen_start"), n_gen))
        cost = cost + F.levenshtein(_piece(est, start["est"], head["est"]), _piece(gen, start["gen"], head["gen"]))
        cost = cost + F.levenshtein(_piece(est, start["est"] - tail["est"], tail["est"]), _piece(gen, start["gen"] - tail["gen"], tail["gen"]))
        rows = rows.withColumn("_cost", cost).withColumn("_est", start["est"]).withColumn("_gen", start["gen"]).withColumn("_est_end", end["est"]).withColumn("_gen_end", end["gen"])
        whole = F.col("_gen_end") - F.col("_gen")
        p = _piece(est, F.col("_est"), F.col("_est_end") - F.col("_est"))
        side = 2 * F.length(p) + 2  # a split reaches no further into the genome's piece
        t = F.when(whole <= 2 * side, _piece(gen, F.col("_gen"), whole)).otherwise(F.concat(_piece(gen, F.col("_gen"), side), _piece(gen, F.col("_gen_end") - side, side)))
        split = rows.withColumn("_s", align.split_border(p, t, None)).filter("_s.edits <= _cost")
        old = (_frequency_at(gen, F.col("a.gen_end") + 1, F.col("b.gen_start")) + _frequency_at(gen, F.col("b.gen_end") + 1, F.col("c.gen_start"))) / 2
        first, after = F.col("_gen") + F.col("_s.left"), F.col("_gen_end") - F.col("_s.right")
        # nothing is left of a neighbour whose bases all cross over
        fits = (F.col("_est") + F.col("_s.cut") > F.col("a.est_start")) & (F.col("_est") + F.col("_s.cut") <= F.col("c.est_end")) & (first > F.col("a.gen_start")) & (after <= F.col("c.gen_end"))
        better = split.filter(fits & (_frequency_at(gen, first, after) >= old))
        cut = F.col("_est") + F.col("_s.cut")
        one = better.select(*ids, F.struct("i", (cut - 1).alias("est_end"), cut.alias("est_start"), (first - 1).alias("gen_end"), after.alias("gen_start")).alias("x")).groupBy(*ids).agg(F.min("x").alias("_x"))
        x, i = F.col("_x"), F.col("_x.i")
        left, right = F.element_at("exons", i - 1), F.element_at("exons", i + 1)
        new = F.concat(F.slice("exons", F.lit(1), i - 2), F.array(_struct(left, est_end=x["est_end"], gen_end=x["gen_end"]), _struct(right, est_start=x["est_start"], gen_start=x["gen_start"])), F.slice("exons", i + 2, F.greatest(F.size("exons") - i - 1, F.lit(0))))
        return now.join(one, list(ids)).select(*ids, new.cast(_EXONS).alias("_new"), (i - 1).cast("bigint").alias("_next"))

    return _rounds(alignments, ids, step)


def hidden(e1: str, g1: str, e2: str, g2: str, sed: int, ped: int, between: str, gap: str, least: int) -> list[tuple]:
    """All exact occurrences of a small exon between two exons (P17). ``e1`` and ``g1`` are
    the last bases of the left exon, ``e2`` and ``g2`` the first of the right one, ``sed``
    and ``ped`` their edits; ``gap`` is the transcript between them, ``between`` the intron.
    Both borders keep PERFECT bases of their longest common piece; all of the transcript
    between them, less what lengthens a border, is looked for. Rows (length, order, bases
    of e1 + gap + e2 before the exon, and before what follows, bases of g1 + between + g2
    before the first intron, the exon, the second intron and what follows), longest first."""
    f1 = align.longest_common_factor(e1, g1) if sed else (0, 0, len(e1))
    f2 = align.longest_common_factor(e2, g2) if ped else (0, 0, len(e2))
    n1, n2 = f1[2], f2[2]
    est, gen = e1 + gap + e2, g1 + between + g2
    if n1 == len(e1) and f2[0] > 0:
        base, more = est[f1[0] + n1 : f1[0] + n1 + 1], 0
        while more + 1 < f2[0] and base and base == g2[more + 1 : more + 2]:
            more += 1
        n1 += more
    first, gfirst = f1[0] + PERFECT, f1[1] + PERFECT
    last, glast = len(e1) + len(gap) + f2[0] + n2 - PERFECT, len(g1) + len(between) + f2[1] + n2 - PERFECT
    n, m = last - first, glast - gfirst
    if n1 < PERFECT or n2 < PERFECT or n < SMALLEST or m < 2 * least + SMALLEST:
        return []
    out = []
    room = m + 1 - 2 * least - SMALLEST
    for a in range(min(n1 + 1 - PERFECT, n + 1 - SMALLEST, room)):
        for b in range(min(n2 + 1 - PERFECT, n + 1 - a - SMALLEST, room - a)):
            exon = est[first + a : last - b]
            at = gen.find(exon, gfirst + a + least, glast - b - least)
            while at >= 0:
                out.append((len(exon), len(out), first + a, last - b, gfirst + a, at, at + len(exon), glast - b))
                at = gen.find(exon, at + 1, glast - b - least)
    return sorted(out, key=lambda x: (-x[0], x[1]))


def known_pattern(candidates: DataFrame) -> Column:
    """Whether both new introns are GT-AG or GC-AG, which classifies them whatever their
    branch points score (F12)."""
    return F.col("pattern1").isin("GTAG", "GCAG") & F.col("pattern2").isin("GTAG", "GCAG")


def with_hidden(alignments: DataFrame, ids: Sequence[str], est: str = "est", gen: str = "genome", min_intron: int = 40, classified: Callable[[DataFrame], Column] = known_pattern) -> DataFrame:
    """Alignments with small exons found in their introns (P17): where both borders
    together have over GOOD edits or the intron isn't classified, the longest exact
    occurrence between them that leaves two classified introns, the first of equals.
    ``classified`` gets the candidates (ids, genome text, the two introns' first and last
    base and patterns) and gives a condition; it also sees the old introns, as both."""
    least = max(4, min_intron)
    names = ("length", "rank", "exon_from", "exon_to", "intron1", "exon_at", "intron2", "rest_at")

    @pandas_udf("array<struct<" + ", ".join(f"{c}: int" for c in names) + ">>")
    def occurrences(*series: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, c, strict=True)) for c in hidden(*x, least)] for x in zip(*series, strict=True)])

    def step(now: DataFrame) -> DataFrame:
        n = F.size("exons")
        pairs = now.filter(n > 1).select(*ids, est, gen, "exons", "_from", F.explode(F.sequence(F.lit(1), n - 1)).alias("i")).filter("i >= _from")
        pairs = pairs.select(*ids, est, gen, "i", F.element_at("exons", F.col("i")).alias("a"), F.element_at("exons", F.col("i") + 1).alias("b"))
        size = lambda e, x: F.col(f"{e}.{x}_end") - F.col(f"{e}.{x}_start") + 1
        w1, w2 = (F.least(size(e, "est"), size(e, "gen"), F.lit(LARGEST)) for e in "ab")
        pieces = {"e1": _piece(est, F.col("a.est_end") + 1 - w1, w1), "g1": _piece(gen, F.col("a.gen_end") + 1 - w1, w1), "e2": _piece(est, F.col("b.est_start"), w2), "g2": _piece(gen, F.col("b.gen_start"), w2)}
        first, last = F.col("a.gen_end") + 1, F.col("b.gen_start") - 1
        rows = pairs.filter(size("a", "est") + size("b", "est") >= SMALLEST + 2 * LARGEST).withColumns(pieces)
        rows = rows.withColumns({"sed": F.levenshtein("e1", "g1"), "ped": F.levenshtein("e2", "g2"), "est0": F.col("a.est_end") + 1 - F.length("e1"), "gen0": F.col("a.gen_end") + 1 - F.length("g1")})
        pattern = lambda s, e: F.upper(F.concat(F.substring(gen, s.cast("int"), F.lit(2)), F.substring(gen, (e - 1).cast("int"), F.lit(2))))
        old = rows.withColumns({"start1": first, "end1": last, "pattern1": pattern(first, last), "start2": first, "end2": last, "pattern2": pattern(first, last)})
        doubtful = old.filter((F.col("sed") + F.col("ped") > GOOD) | ~classified(old)).drop("start1", "end1", "pattern1", "start2", "end2", "pattern2")
        between, gap = _piece(gen, first, last - first + 1), _piece(est, F.col("a.est_end") + 1, F.col("b.est_start") - F.col("a.est_end") - 1)
        found = doubtful.withColumn("_o", occurrences("e1", "g1", "e2", "g2", "sed", "ped", between, gap)).select(*ids, gen, "i", "est0", "gen0", F.explode("_o").alias("o"))
        at = lambda c: F.col("gen0") + F.col(f"o.{c}")
        new = found.withColumns({"start1": at("intron1"), "end1": at("exon_at") - 1, "start2": at("intron2"), "end2": at("rest_at") - 1})
        new = new.withColumns({"pattern1": pattern(F.col("start1"), F.col("end1")), "pattern2": pattern(F.col("start2"), F.col("end2"))})
        good = new.filter(classified(new))
        best = F.struct("i", (-F.col("o.length")).alias("l"), "o.rank", "start1", "end1", "start2", "end2", (F.col("est0") + F.col("o.exon_from")).alias("exon_from"), (F.col("est0") + F.col("o.exon_to")).alias("rest_from"))
        one = good.select(*ids, best.alias("x")).groupBy(*ids).agg(F.min("x").alias("_x"))
        x, i = F.col("_x"), F.col("_x.i")
        left, right = F.element_at("exons", i), F.element_at("exons", i + 1)
        exon = F.struct(*(v.cast("bigint").alias(c) for c, v in (("est_start", x["exon_from"]), ("est_end", x["rest_from"] - 1), ("gen_start", x["end1"] + 1), ("gen_end", x["start2"] - 1))))
        three = F.array(_struct(left, est_end=x["exon_from"] - 1, gen_end=x["start1"] - 1), exon, _struct(right, est_start=x["rest_from"], gen_start=x["end2"] + 1))
        exons = F.concat(F.slice("exons", F.lit(1), i - 1), three, F.slice("exons", i + 2, F.greatest(F.size("exons") - i - 1, F.lit(0))))
        # the right exon, now two places on, and what follows
        return now.join(one, list(ids)).select(*ids, exons.cast(_EXONS).alias("_new"), (i + 2).cast("bigint").alias("_next"))

    return _rounds(alignments, ids, step)
