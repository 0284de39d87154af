"""The search for splice sites beside an alignment's introns.

The transcript around a junction is aligned to the ends of both exons and of the intron,
with one free gap. Where that gap isn't GT ... AG, bases are carried from one exon to the
other: AGs are looked for in the exon after the intron, GTs in the intron before, and the
bases in between must fit on the other side nearly as well. Then the mirrored way, then
both ways for GC ... AG, and at last the most frequent pattern along identical bases.

Only texts of up to two windows go to Python; they are cut in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import computed_once
from . import align

#: Bases of exon and intron around a junction, columns that a comparison is extended by, sites
#: that are tried, edits up to which carried bases count as aligned, and how far sites may move.
EXON, INTRON, EXTRA, SITES, ALIGNED, SHIFT = 30, 70, 8, 2, 5, 20


class Junction(NamedTuple):
    """Alignment of a junction: columns of both exons, and the intron's two ends."""

    left: tuple[str, str]  # transcript and genome, with - for spaces
    right: tuple[str, str]
    first: str  # intron bases after the left exon
    last: str  # intron bases before the right exon


def _sites(text: str, pair: str) -> Iterator[int]:
    at = text.find(pair)
    while at >= 0:
        yield at
        at = text.find(pair, at + 1)


def _in_exon(near: str, est: str, gen: str, pair: str) -> list[tuple[int, int]]:
    """The nearest SITES places in an exon's columns, read away from the intron, where the
    genome has ``pair`` (it may begin in the intron's last bases): how many genome and
    transcript bases lie before its end."""
    letters = [(c, -1) for c in near[-2:]] + [(c, k) for k, c in enumerate(gen) if c != "-"]
    out = []
    for (x, _), (y, k) in zip(letters, letters[1:], strict=False):
        if x + y == pair and len(out) < SITES:
            out.append((sum(c != "-" for c in gen[: k + 1]), sum(c != "-" for c in est[: k + 1])))
    return out


def _edits(a: str, b: str) -> int:
    """Edit distance of texts of a few bases, for which arrays cost more than they save."""
    row = list(range(len(b) + 1)) if a != b else [0]
    for i, x in enumerate(a if a != b else "", 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def carried(giver: tuple[str, str], near: str, far: str, taker: tuple[str, str], near_pair: str, far_pair: str, exact: bool) -> tuple[int, int, int] | None:
    """Bases carried over an intron: ``giver`` and ``taker`` are the columns of the exons
    read away from it, ``near`` (``far``) the intron beside the giver (taker), read towards
    the giver. Returns genome and transcript bases that the giver loses and bases of the
    intron that the taker gains, or None. Bases count by their edits on the other side less
    those on their own, where the taker's next columns have mismatches together with
    these. At most one more edit is allowed for; ``exact``: the first pair of sites without
    a further edit, of all pairs."""
    (est, gen), own = giver, [x[:EXTRA] for x in taker]
    errors = sum(a != b for a, b in zip(*own, strict=True))
    beside = ["".join(reversed(x.replace("-", ""))) for x in own] if errors else ["", ""]
    plain_est, plain_gen = est.replace("-", ""), gen.replace("-", "")
    best = None
    for g, e in _in_exon(near, est, gen, near_pair):
        before = _edits(plain_est[:e], plain_gen[:g])
        for d in list(_sites(far, far_pair))[:SITES]:
            cost = _edits(beside[0] + plain_est[:e], beside[1] + far[:d]) - errors
            if exact:
                if best is None or cost < best[0]:
                    best = cost, (g, e, d)
                if best[0] == 0:
                    return best[1]
            elif before <= ALIGNED and 0 <= cost - before <= 1:
                return g, e, d
    return None


def _turned(columns: tuple[str, str]) -> tuple[str, str]:
    return columns[0][::-1], columns[1][::-1]


def _slide(j: Junction, frequency, room: tuple[int, int]) -> int:
    """How far the intron moves along identical bases to its most frequent pattern: first
    to the left, then to the right, of equal ones the first."""
    left, right = ([x.replace("-", "") for x in side] for side in (j.left, j.right))
    genome_left, at = left[1] + j.first, len(left[1])
    genome_right, to = j.last + right[1], len(j.last)
    est, cut = left[0] + right[0], len(left[0])
    best, found = 0, 0
    k = 0
    while cut + k > room[0] + 1 and cut + k < len(est) and to + k >= 2 and at + k >= 0 and est[cut + k] == genome_right[to + k]:
        n = frequency(genome_left[at + k : at + k + 2] + genome_right[to + k - 2 : to + k])
        if n > best:
            best, found = n, k
        k -= 1
    k = 1
    while cut + k - 1 < room[1] and cut + k - 1 < len(est) and at + k + 1 < len(genome_left) and to + k < len(genome_right) and est[cut + k - 1] == genome_left[at + k - 1]:
        n = frequency(genome_left[at + k : at + k + 2] + genome_right[to + k - 2 : to + k])
        if n > best:
            best, found = n, k
        k += 1
    return found


def search(j: Junction, frequency, room: tuple[int, int]) -> tuple[int, int, int, str]:
    """How far the left exon's end, the right exon's start and the cut of the transcript
    move, and why: canonical, GT, GC, or pattern. ``room``: the first and the last
    transcript base, from the start of the junction's, that a slide may come to."""
    if j.first[:2] == "GT" and j.last[-2:] == "AG":
        return 0, 0, 0, "canonical"
    for donor, exact in (("GT", False), ("GC", True)):
        # the right exon gives: its bases fit after the left exon
        moved = carried(j.right, j.last, j.first, _turned(j.left), "AG", donor, exact)
        if moved:
            g, e, d = moved
            return d, g, e, donor
        # the left exon gives: the same, mirrored
        moved = carried(_turned(j.left), j.first[::-1], j.last[::-1], j.right, donor[::-1], "GA", exact)
        if moved:
            g, e, d = moved
            return -g, -d, -e, donor
    k = _slide(j, frequency, room)
    return k, k, k, "pattern"


def junctions(est: Sequence[str], left: Sequence[str], right: Sequence[str]) -> list[tuple[int, int, int, Junction]]:
    """For texts around junctions (the transcript's, and exon and intron on the genome's
    left and right): the transcript's cut, the left exon's bases, the place of the right
    exon's first base in both genome parts joined, and the junction."""
    whole = [a + b for a, b in zip(left, right, strict=True)]
    found = align.gap_alignments(list(est), whole)
    cuts = [(e[:c], g[: s - 1], e[c:], g[t:]) for e, g, (_, c, s, t) in zip(est, whole, found, strict=True)]
    sides = [align.global_alignments([c[k] for c in cuts], [c[k + 1] for c in cuts]) for k in (0, 2)]
    return [
        (c, s - 1, t, Junction(tuple(a[:2]), tuple(b[:2]), g[s - 1 : max(len(l), s - 1)], g[min(len(l), t) : t]))
        for (_, c, s, t), g, l, a, b in zip(found, whole, left, *sides, strict=True)
    ]


def refined(est: Column, left: Column, right: Column, sizes: Column, min_intron: int = 40) -> Column:
    """struct<donor, acceptor, cut, how> of a junction: how far the left exon's end and the
    right exon's start move on the genome, and the transcript bases of the text before the
    right exon. ``sizes`` is an array: exon bases in the left and in the right genome text,
    the intron's length, the transcript bases of both exons that the text leaves out, and
    both exons' lengths on the genome. Where the junction stays (``how`` is short, far or
    lost) the rest is null; ``how`` is attached where the left exon has no base left."""
    known = align._frequency()

    @pandas_udf("donor int, acceptor int, cut int, how string")
    def run(*series: pd.Series) -> pd.DataFrame:
        e, l, r = (["" if t is None else t.upper() for t in s] for s in series[:3])
        out: list = [None] * len(e)
        for part in align._parts(e, [a + b for a, b in zip(l, r, strict=True)]):
            for i, (cut, start, end, j) in zip(part, junctions([e[i] for i in part], [l[i] for i in part], [r[i] for i in part]), strict=True):
                in_left, in_right, length, room_left, room_right, left_size, right_size = map(int, series[3].iloc[i])
                donor, acceptor = start - in_left, end - (len(l[i]) + len(r[i]) - in_right)
                if cut == 0 and room_left == 0:
                    out[i] = 0, acceptor, 0, "attached"
                elif length + 1 + acceptor - donor < min_intron:
                    out[i] = None, None, None, "short"
                elif max(abs(donor), abs(acceptor)) > SHIFT:
                    out[i] = None, None, None, "far"
                else:
                    a, b, c, how = search(j, known, (-room_left, len(e[i]) - 1 + room_right))
                    lost = how != "canonical" and (acceptor + b >= right_size or donor + a <= -left_size)
                    out[i] = (None, None, None, "lost") if lost else (donor + a, acceptor + b, cut + c, how)
        return pd.DataFrame(out, columns=["donor", "acceptor", "cut", "how"]).astype({c: "Int32" for c in ("donor", "acceptor", "cut")})

    return run(est, left, right, sizes)


def refine(alignments: DataFrame, est: str = "est", gen: str = "genome", min_intron: int = 40) -> DataFrame:
    """Alignments (``exons``, an array of est_start, est_end, gen_start, gen_end, and the
    texts) with all junctions refined, each as it was found. A first exon that is attached
    to the second goes. An alignment that an exon would be lost from stays as it was."""
    n = F.size("exons")
    at = lambda i: F.element_at("exons", i)
    piece = lambda text, start, end: F.substring(text, start.cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int"))

    def texts(i: Column) -> Column:
        a, b = at(i), at(i + 1)
        est_from, est_to = F.greatest(a["est_start"], a["est_end"] - EXON + 1), F.least(b["est_end"], b["est_start"] + EXON - 1)
        gen_from, gen_to = F.greatest(a["gen_start"], a["gen_end"] - EXON + 1), F.least(b["gen_end"], b["gen_start"] + EXON - 1)
        left_to, right_from = F.least(a["gen_end"] + INTRON, F.length(gen)), F.greatest(b["gen_start"] - INTRON, F.lit(1))
        sizes = F.array(a["gen_end"] - gen_from + 1, gen_to - b["gen_start"] + 1, b["gen_start"] - a["gen_end"] - 1, est_from - a["est_start"], b["est_end"] - est_to, a["gen_end"] - a["gen_start"] + 1, b["gen_end"] - b["gen_start"] + 1)
        return F.struct(piece(est, est_from, est_to).alias("est"), piece(gen, gen_from, left_to).alias("left"), piece(gen, right_from, gen_to).alias("right"), sizes.cast("array<bigint>").alias("sizes"), est_from.alias("est_from"))

    keyed = computed_once(alignments, "exons").withColumn("_key", F.monotonically_increasing_id())
    each = keyed.filter(n > 1).select("_key", est, gen, "exons", F.explode(F.sequence(F.lit(1), n - 1)).alias("i")).select("_key", "i", texts(F.col("i")).alias("x"))
    moved = each.select("_key", "i", "x.est_from", refined(F.col("x.est"), F.col("x.left"), F.col("x.right"), F.col("x.sizes"), min_intron).alias("m"))
    moves = moved.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("i", "est_from", "m.donor", "m.acceptor", "m.cut", "m.how"))).alias("_moves"))
    rows = keyed.join(moves, "_key", "left").withColumn("_moves", F.coalesce("_moves", F.array().cast(moves.schema["_moves"].dataType)))

    def exon(e: Column, i: Column) -> Column:
        # moves of the junctions before and after exon i (from 0)
        before = F.try_element_at("_moves", F.when(i > 0, i))
        after = F.try_element_at("_moves", i + 1)
        fixed = lambda m, k: m["cut"].isNotNull() & ((m["how"] != "attached") | (k == 1))
        start, end = F.coalesce(fixed(before, i), F.lit(False)), F.coalesce(fixed(after, i + 1) & (after["how"] != "attached"), F.lit(False))
        return F.struct(
            F.when(start, before["est_from"] + before["cut"]).otherwise(e["est_start"]).alias("est_start"),
            F.when(end, after["est_from"] + after["cut"] - 1).otherwise(e["est_end"]).alias("est_end"),
            F.when(start, e["gen_start"] + before["acceptor"]).otherwise(e["gen_start"]).alias("gen_start"),
            F.when(end, e["gen_end"] + after["donor"]).otherwise(e["gen_end"]).alias("gen_end"),
        )

    attached = F.coalesce(F.try_element_at("_moves", F.lit(1))["how"] == "attached", F.lit(False))
    new = F.transform("exons", exon)
    new = F.when(attached, F.slice(new, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(new)
    whole = F.forall("_new", lambda e: (e["est_start"] <= e["est_end"]) & (e["gen_start"] <= e["gen_end"]))
    return computed_once(rows.withColumn("_new", new), "_new").withColumn("exons", F.when(whole, F.col("_new").cast(alignments.schema["exons"].dataType)).otherwise(F.col("exons"))).drop("_key", "_moves", "_new")
