"""From pairings to alignments: path-compatible extension (P01), the maximal paths of a
transcript's graph (G03), exons of a path (P02), trimmed ends (P05) and filled gaps (P11).

Pairings are (p, t, l), 0-based starts on transcript and genome and a length; exons are
1-based. A path is extended from its sink backwards. Every pairing has a frontier: of the
partial paths that start with it, those that no other one contains, pairing by pairing. So
what is held is an antichain for each pairing, and paths that are going to lose are dropped
where they start to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import pattern_frequency
from ..session import computed_once
from . import align

#: Edits that filled gaps may cost in all, and bases up to which exons are one.
GAP_EDITS, JOINED = 20, 3

Pairing = tuple[int, int, int]


def extend(node: Pairing, head: Pairing, frequencies: Sequence[int], least: int, min_intron: int) -> tuple[int, Pairing] | None:
    """``node`` put in front of a path that starts with ``head`` (P01): the length that
    node keeps and what head becomes, or None where they don't fit. Both together must
    span two factors on each axis, the transcript may have a gap of as much, and the genome
    one of as much or an intron. An overlap is halved; where there is an intron too, it is
    cut at the last place with the most frequent splice pattern that leaves a factor on
    each side. ``frequencies`` belongs to the places from max(p1 + least, p2) on."""
    (p1, t1, l1), (p2, t2, l2) = node, head
    on_p, on_t, span = p2 + l2 - p1, t2 + l2 - t1, 2 * least
    if min(on_p, on_t) < span or on_p - l1 - l2 > span or on_p - on_t > span:
        return None
    keep1, keep2 = l1, l2
    if min(on_p, on_t) < l1 + l2:
        both = min(on_p, on_t)
        keep1 = min(both // 2, l1)
        keep2 = min(both - keep1, l2)
        keep1 = both - keep2
    gap_p, gap_t = (x + l2 - keep2 - y - keep1 - 1 for x, y in ((p2, p1), (t2, t1)))
    intron = gap_t - max(0, gap_p)
    is_intron = intron >= max(0, min_intron)
    if on_p < l1 + l2 and is_intron:
        low, high = max(p1 + least, p2), min(p2 + l2 - least, p1 + l1)
        if low <= high:
            found = np.asarray(frequencies[: high - low + 1])
            cut = high - int(np.argmax(found[::-1]))
            keep1, keep2 = cut - p1, p2 + l2 - cut
    if gap_t > span and not is_intron:
        return None
    return keep1, (p2 + l2 - keep2, t2 + l2 - keep2, keep2)


def within(a: Sequence[Pairing], b: Sequence[Pairing]) -> bool:
    """Whether path ``a`` lies, pairing by pairing from the start, inside ``b``."""
    return len(a) <= len(b) and all(q <= p and p + l <= q + m and u <= t and t + l <= u + m for (p, t, l), (q, u, m) in zip(a, b, strict=False))


def add_maximal(found: list[tuple], new: tuple) -> None:
    """``new`` joins an antichain of paths, unless it is in one; those within it go."""
    if not any(within(new, old) for old in found):
        found[:] = [old for old in found if not within(old, new)]
        found.append(new)


def frontier(pairings: Sequence[Pairing], after: dict[Pairing, list[tuple[Pairing, Sequence[int]]]], sinks: set[Pairing], sources: set[Pairing], least: int, min_intron: int) -> list[tuple]:
    """The maximal paths from sources to sinks (G03). ``after`` has the successors of each
    pairing, in order, with the frequencies of their cuts; they start later on the
    transcript."""
    own: dict[Pairing, list[tuple]] = {}
    for v in sorted(pairings, reverse=True):
        own[v] = found = [(v,)] if v in sinks else []
        for w, frequencies in after.get(v, ()):
            for path in own[w]:
                fits = extend(v, path[0], frequencies, least, min_intron)
                if fits:
                    add_maximal(found, ((*v[:2], fits[0]), fits[1], *path[1:]))
    out: list[tuple] = []
    for v in sorted(sources):
        for path in own[v]:
            add_maximal(out, path)
    return out


def with_cuts(edge_rows: DataFrame, genome: DataFrame, on: Sequence[str], least: int = 15) -> DataFrame:
    """Edges (p1, t1, l1, p2, t2, l2) with ``cuts``: the frequency of the splice pattern at
    each place where their overlap on the transcript may be cut. ``genome`` has ``on`` and seq."""
    low, high = F.greatest(F.col("p1") + least, F.col("p2")), F.least(F.col("p2") + F.col("l2") - least, F.col("p1") + F.col("l1"))
    overlap = (F.col("p2") < F.col("p1") + F.col("l1")) & (low <= high)
    # the pieces of the genome with all donors and all acceptors, so that whole texts are gone
    # through once for an edge; an acceptor that starts before the text has no pattern
    first = low - F.col("p2") + F.col("t2") - 1
    piece = lambda at: F.when(overlap, F.substring("_g", at.cast("int"), (high - low + 2).cast("int")))
    rows = edge_rows.join(genome.select(*on, F.col("seq").alias("_g")), list(on))
    rows = rows.withColumns({"_low": low, "_high": high, "_skip": F.greatest(1 - first, F.lit(0)), "_d": piece(low - F.col("p1") + F.col("t1") + 1), "_a": piece(F.greatest(first, F.lit(1)))}).drop("_g")
    rows = computed_once(rows, "_low", "_high", "_skip", "_d", "_a")
    two = lambda text, at: F.substring(text, at.cast("int"), F.lit(2))
    here = lambda i: F.when(i >= F.col("_skip"), pattern_frequency(two("_d", i + 1), two("_a", i - F.col("_skip") + 1))).otherwise(0).cast("int")
    cuts = F.when(F.col("_d").isNotNull(), F.transform(F.sequence(F.lit(0), F.greatest(F.col("_high") - F.col("_low"), F.lit(0))), here)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("cuts", cuts).drop("_low", "_high", "_skip", "_d", "_a")


def maximal_paths(pairings: DataFrame, edge_rows: DataFrame, ids: Sequence[str], ends: DataFrame | None = None, least: int = 15, min_intron: int = 40) -> DataFrame:
    """ids, path_no and ``path`` (array of p, t, l): the maximal paths of each transcript
    (G03) over edges ``with_cuts``. ``ends`` has ids, kind (source, sink), p, t, l; without
    it, pairings that no edge enters (leaves) are sources (sinks). A transcript's graph is one
    group; the gate of complexity (G04) bounds it."""
    plain = pairings.select(*ids, *(F.col(c).cast("bigint").alias(f"{c}1") for c in "ptl"), *(F.lit(None).cast("bigint").alias(f"{c}2") for c in "ptl"), F.lit(None).cast("array<int>").alias("cuts"), F.lit(None).cast("string").alias("kind"))
    rows = plain.unionByName(edge_rows.select(*ids, *(F.col(f"{c}{k}").cast("bigint").alias(f"{c}{k}") for k in (1, 2) for c in "ptl"), "cuts", F.lit("edge").alias("kind")))
    if ends is not None:
        rows = rows.unionByName(ends.select(*ids, *(F.col(c).cast("bigint").alias(f"{c}1") for c in "ptl"), "kind"), allowMissingColumns=True)

    leaves_end = ends is None

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        one = list(zip(*(part[c].tolist() for c in ("p1", "t1", "l1")), strict=True))
        after: dict[Pairing, list] = {}
        entered, sinks, sources = set(), set(), set()
        for v, kind, p, t, l, cuts in zip(one, part["kind"], part["p2"], part["t2"], part["l2"], part["cuts"], strict=True):
            if kind == "edge":
                w = (int(p), int(t), int(l))
                after.setdefault(v, []).append((w, cuts))
                entered.add(w)
            elif kind is not None:
                (sinks if kind == "sink" else sources).add(v)
        for v in after:
            after[v].sort(key=lambda x: x[0])
        vertices = set(one) | entered
        if leaves_end:
            sinks, sources = vertices - set(after), vertices - entered
        found = frontier(vertices, after, sinks, sources, least, min_intron)
        head = {c: part[c].iloc[0] for c in ids}
        return pd.DataFrame([{**head, "path_no": i + 1, "path": [{"p": p, "t": t, "l": l} for p, t, l in path]} for i, path in enumerate(found)], columns=[*ids, "path_no", "path"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pairings.select(*ids).schema), "path_no int, path array<struct<p: bigint, t: bigint, l: bigint>>"])
    return rows.groupBy(*ids).applyInPandas(solve, schema)


_EXON = "struct<est_start: bigint, est_end: bigint, gen_start: bigint, gen_end: bigint>"


def path_exons(path: Column, least: int = 15) -> Column:
    """Exons of a path (P02): pairings up to two factors apart on the genome are one."""
    exon = lambda x: F.struct((x["p"] + 1).alias("est_start"), (x["p"] + x["l"]).alias("est_end"), (x["t"] + 1).alias("gen_start"), (x["t"] + x["l"]).alias("gen_end"))

    def step(exons: Column, x: Column) -> Column:
        last = F.element_at(exons, -1)
        grown = F.struct(last["est_start"].alias("est_start"), (x["p"] + x["l"]).alias("est_end"), last["gen_start"].alias("gen_start"), (x["t"] + x["l"]).alias("gen_end"))
        joined = F.concat(F.slice(exons, F.lit(1), F.size(exons) - 1), F.array(grown))
        return F.when((F.size(exons) > 0) & (x["t"] - F.try_element_at(exons, F.lit(-1))["gen_end"] <= 2 * least), joined).otherwise(F.concat(exons, F.array(exon(x))))

    empty = F.array().cast(f"array<{_EXON}>")
    first = F.when(F.size(path) > 0, F.array(exon(F.element_at(path, 1)))).otherwise(empty).cast(f"array<{_EXON}>")
    return F.aggregate(F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), first, lambda e, x: step(e, x).cast(f"array<{_EXON}>"))


def start_cut(est: str, gen: str, run: int = 6) -> tuple[int, int] | None:
    """Columns of an alignment up to the first run of matches (P05): the bases cut on each
    side; None without a run that something follows."""
    a = b = matches = 0
    for x, y in zip(est, gen, strict=True):
        if matches >= run:
            return a - matches, b - matches
        a, b = a + (x != "-"), b + (y != "-")
        matches = matches + 1 if x == y else 0
    return None


def end_kept(est: str, gen: str, run: int = 11) -> tuple[int, int]:
    """Bases kept on each side so that an alignment ends with a run of matches (P05), or
    with the run it starts with. A gap behind the run is closed where the next base on the
    gapped side is the one that stands against it."""
    x, y = list(est), list(gen)
    a, b, matches, j = sum(c != "-" for c in x), sum(c != "-" for c in y), 0, len(x) - 1
    while j >= 0 and matches < run:
        same = x[j] == y[j]
        a, b = a - (x[j] != "-"), b - (y[j] != "-")
        matches = matches + 1 if same else 0
        j -= 1
    a, b, at = a + matches, b + matches, j + matches + 1
    while at < len(x) - 1 and "-" in (x[at], y[at]):
        gapped, whole = (x, y) if x[at] == "-" else (y, x)
        behind = next((k for k in range(at + 1, len(gapped)) if gapped[k] != "-"), None)
        if behind is None or gapped[behind] != whole[at]:
            break
        gapped[at], gapped[behind] = gapped[behind], "-"
        a, b, at = a + 1, b + 1, at + 1
    return a, b


def cut_start(est: Column, gen: Column, run: int = 6) -> Column:
    """struct<est, gen>: ``start_cut`` of a first exon; null: the exon goes. Equal starts are
    aligned to each other, and the rest isn't looked at."""
    equal = (F.length(est) > run) & (F.length(gen) > run) & (F.left(est, F.lit(run)) == F.left(gen, F.lit(run)))
    found = align._pairs_udf(align.global_alignments, align.global_alignment, "est int, gen int", F.when(equal, "").otherwise(est), F.when(equal, "").otherwise(gen), finish=lambda found, *_: start_cut(*found[:2], run) or (None, None))
    return F.when(equal, F.struct(F.lit(0).alias("est"), F.lit(0).alias("gen"))).otherwise(found)


def keep_end(est: Column, gen: Column, run: int = 11) -> Column:
    """struct<est, gen>: ``end_kept`` of a last exon; without a base on the genome it goes.
    Equal ends are aligned to each other, and the rest isn't looked at."""
    equal = (F.length(est) >= run) & (F.length(gen) >= run) & (F.right(est, F.lit(run)) == F.right(gen, F.lit(run)))
    found = align._pairs_udf(align.global_alignments, align.global_alignment, "est int, gen int", F.when(equal, "").otherwise(est), F.when(equal, "").otherwise(gen), finish=lambda found, *_: end_kept(*found[:2], run))
    return F.when(equal, F.struct(F.length(est).alias("est"), F.length(gen).alias("gen"))).otherwise(found)


def _piece(text: str, start: Column, end: Column) -> Column:
    return F.substring(text, start.cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int"))


def trimmed(alignments: DataFrame, est: str = "est", gen: str = "genome") -> DataFrame:
    """Alignments (``exons``, an array of _EXON, with the texts) whose first and last exon
    are trimmed to matches (P05): first the first exon, then the last of what is left. An
    exon without its run goes; alignments without exons go."""
    size, e = F.size("exons"), F.col("_e")
    kept = lambda **new: F.struct(*(new.get(c, e[c]).cast("bigint").alias(c) for c in ("est_start", "est_end", "gen_start", "gen_end")))

    def outer(rows: DataFrame, at: int, compare: Callable) -> DataFrame:
        rows = computed_once(rows.filter(size > 0).withColumn("_e", F.element_at("exons", at)), "_e")
        rows = computed_once(rows.withColumn("_x", _piece(est, e["est_start"], e["est_end"])).withColumn("_y", _piece(gen, e["gen_start"], e["gen_end"])), "_x", "_y")
        return computed_once(rows.withColumn("_c", compare(F.col("_x"), F.col("_y"))), "_c")

    rows = outer(computed_once(alignments, "exons"), 1, cut_start)
    rest = F.slice("exons", F.lit(2), size - 1)
    new = kept(est_start=e["est_start"] + F.col("_c.est"), gen_start=e["gen_start"] + F.col("_c.gen"))
    rows = computed_once(rows.withColumn("exons", F.when(F.col("_c.est").isNull(), rest).otherwise(F.concat(F.array(new), rest))), "exons")
    rows = outer(rows, -1, keep_end)
    front = F.slice("exons", F.lit(1), size - 1)
    new = kept(est_end=e["est_start"] + F.col("_c.est") - 1, gen_end=e["gen_start"] + F.col("_c.gen") - 1)
    rows = rows.withColumn("exons", F.when(F.col("_c.gen") <= 0, front).otherwise(F.concat(front, F.array(new))))
    return computed_once(rows, "exons").filter(size > 0).drop("_c", "_e", "_x", "_y")


def _ends(text: str, start: Column, end: Column, reach: Column) -> Column:
    """The span [start, end] of a text, without its middle where that can't matter."""
    whole, side = end - start + 1, reach + 2
    return F.when(whole <= 2 * side, _piece(text, start, end)).otherwise(F.concat(_piece(text, start, start + side - 1), _piece(text, end - side + 1, end)))


def filled(alignments: DataFrame, ids: Sequence[str], est: str = "est", gen: str = "genome") -> DataFrame:
    """Alignments (ids, exons, the texts) whose transcript gaps are split between the exons
    beside them (F17, P11), and exons up to JOINED apart on the genome made one. Those
    go that would cost over GAP_EDITS, or that have a gap longer than the genome's."""
    w = Window.partitionBy(*ids).orderBy("ord")
    rows = alignments.select(*ids, est, gen, F.posexplode("exons").alias("ord", "e")).select(*ids, est, gen, "ord", "e.*")
    after_est, after_gen = F.lead("est_start").over(w), F.lead("gen_start").over(w)
    gaps = rows.withColumn("_p", after_est - F.col("est_end") - 1).withColumn("_t", after_gen - F.col("gen_end") - 1).filter("_p > 0")
    n = F.col("_p").cast("int")
    # a gap is split with at most as many edits as it has bases
    split = align.split_border(_piece(est, F.col("est_end") + 1, F.col("est_end") + F.col("_p")), _ends(gen, F.col("gen_end") + 1, F.col("gen_end") + F.col("_t"), 2 * n), None)
    found = gaps.withColumn("_s", F.when(F.col("_p") <= F.col("_t"), split)).select(*ids, "ord", "_p", "_t", F.col("_s.edits").alias("_edits"), F.col("_s.cut").alias("_cut"), F.col("_s.left").alias("_left"), F.col("_s.right").alias("_right"))
    both = rows.drop(est, gen).join(found, [*ids, "ord"], "left")
    cost = F.sum(F.coalesce("_edits", F.when(F.col("_p").isNotNull(), GAP_EDITS + 1), F.lit(0))).over(Window.partitionBy(*ids))
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    moved = both.withColumn("_cost", cost).filter(F.col("_cost") <= GAP_EDITS).select(
        *ids, "ord",
        (F.col("est_start") - before("_p") + before("_cut")).alias("est_start"), (F.col("est_end") + F.coalesce("_cut", F.lit(0))).alias("est_end"),
        (F.col("gen_start") - before("_right")).alias("gen_start"), (F.col("gen_end") + F.coalesce("_left", F.lit(0))).alias("gen_end"),
    )
    new = F.when(F.col("gen_start") - F.lag("gen_end").over(w) - 1 <= JOINED, 0).otherwise(1)
    runs = moved.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy(*ids, "_run").agg(F.min("est_start").alias("est_start"), F.max("est_end").alias("est_end"), F.min("gen_start").alias("gen_start"), F.max("gen_end").alias("gen_end"))
    exons = joined.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("est_start", "est_end", "gen_start", "gen_end"))).cast(f"array<{_EXON}>").alias("exons"))
    return alignments.drop("exons").join(exons, list(ids))
