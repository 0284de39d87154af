"""Rules that refine alignments: tails, ends, containment of one transcript's
alignments, poly-A flags, agreement with a reference."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.sequence import allowed_errors, dust_scores
from ..session import computed_once
from . import align


def _cut_exon(text: str, e: Column, side: str) -> Column:
    start, end = e[f"{side}_start"], e[f"{side}_end"]
    return F.substring(text, start.cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int"))


def _best_runs(lengths: pd.Series, bad: pd.Series) -> pd.DataFrame:
    out = []
    for size, flags in zip(lengths, bad, strict=True):
        best, start, total = (0, 1, 0), 0, 0  # bases, first (1-based), exons
        for i, (n, wall) in enumerate([*zip(size, flags, strict=True), (0, True)]):
            if wall:
                best = max(best, (total, start + 1, i - start), key=lambda x: x[0])
                start, total = i + 1, 0
            else:
                total += n
        out.append(best[1:])
    return pd.DataFrame(out, columns=["first", "n"])


def best_run(alignments: DataFrame, bad: Column) -> DataFrame:
    """Of each alignment's runs of exons between bad ones (``bad``: a flag for each) the one
    with the most genome bases, the first of equals (W09); none is left of no run."""
    lengths = F.transform("exons", lambda e: F.greatest(e["gen_end"] - e["gen_start"] + 1, F.lit(0)))
    rows = alignments.withColumn("_run", F.pandas_udf(_best_runs, "first int, n int")(lengths, bad))
    return computed_once(rows.withColumn("exons", F.slice("exons", F.col("_run.first"), F.col("_run.n"))).drop("_run"), "exons").filter(F.size("exons") > 0)


def without_noisy(alignments: DataFrame, est: str = "est", gen: str = "genome") -> DataFrame:
    """The best run between exons with more edits than their length allows."""
    most = lambda e: allowed_errors(e["gen_end"] - e["gen_start"] + 1)
    # banded: beyond the limit it gives -1
    edits = lambda e: F.call_function("levenshtein", _cut_exon(gen, e, "gen"), _cut_exon(est, e, "est"), most(e))
    return best_run(alignments, F.transform("exons", lambda e: (e["gen_start"] > e["gen_end"]) | (edits(e) < 0)))


def without_low_complexity(alignments: DataFrame, est: str = "est", gen: str = "genome", most: float = 20) -> DataFrame:
    """The best run between exons whose transcript or genome is of low complexity."""
    cut = lambda text, side: dust_scores(F.transform("exons", lambda e: _cut_exon(text, e, side)))
    rows = alignments.withColumn("_a", cut(est, "est")).withColumn("_b", cut(gen, "gen"))
    return best_run(rows, F.zip_with("_a", "_b", lambda a, b: (a > most) | (b > most))).drop("_a", "_b")


def without_bad_ends(alignments: DataFrame, est: str = "est", gen: str = "genome") -> DataFrame:
    """Outer exons of under 10 bases go, and those of under 20 that have edits or no GT-AG
    or GC-AG beside them (P06): first the first one, then the last of what is left."""
    size = F.size("exons")
    for first in (True, False):
        sides = F.element_at("exons", 1 if first else -1), F.try_element_at("exons", F.lit(2 if first else -2))
        rows = computed_once(alignments.filter(size > 0).withColumns({"_e": sides[0], "_o": sides[1]}), "_e", "_o")
        e, other = F.col("_e"), F.col("_o")
        a, b = (e, other) if first else (other, e)
        pattern = F.upper(F.concat(F.substring(gen, (a["gen_end"] + 1).cast("int"), F.lit(2)), F.substring(gen, (b["gen_start"] - 2).cast("int"), F.lit(2))))
        same = _cut_exon(gen, e, "gen") == _cut_exon(est, e, "est")
        fails = align.external_exon_fails(e["gen_end"] - e["gen_start"] + 1, F.when(same, 0).otherwise(1), F.coalesce(pattern, F.lit("")))
        rest = F.slice("exons", F.lit(2 if first else 1), F.greatest(size - 1, F.lit(0)))
        rows = rows.withColumn("exons", F.when(fails, rest).otherwise(F.col("exons")))
        alignments = computed_once(rows, "exons").drop("_e", "_o")
    return alignments.filter(size > 0)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: doubled while prefixes are equal, and then
    bisected, so that texts which part early are hardly read."""
    n = F.least(F.length(a), F.length(b))
    powers = [1 << k for k in range(31)]
    same = lambda k: (k <= n) & (F.left(a, k) == F.left(b, k))
    top = F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda have, p: F.when((F.greatest(have * 2, F.lit(1)) == p) & same(p), p).otherwise(have))
    start = F.struct(top.alias("have"), top.alias("top"))
    step = lambda s, p: F.when((p < s["top"]) & same(s["have"] + p), F.struct((s["have"] + p).alias("have"), s["top"].alias("top"))).otherwise(s)
    return F.aggregate(F.array(*map(F.lit, reversed(powers))), start, step)["have"].cast("bigint")


def extend_tail(est_end: Column, gen_end: Column, est: Column, gen: Column) -> Column:
    """struct<est_end, gen_end>: the last exon (1-based ends) grown while transcript and
    genome agree (F07)."""
    more = common_prefix(F.substring(est, est_end + 1, F.length(est)), F.substring(gen, gen_end + 1, F.length(gen)))
    return F.struct((est_end + more).alias("est_end"), (gen_end + more).alias("gen_end"))


def ends_match(est: Column, gen: Column, first: int = 6, last: int = 11) -> Column:
    """Whether an exon starts with ``first`` equal bases and ends with ``last``."""
    return F.struct((F.left(est, F.lit(first)) == F.left(gen, F.lit(first))).alias("starts"), (F.right(est, F.lit(last)) == F.right(gen, F.lit(last))).alias("ends"))


def join_exons(rows: DataFrame, ids: Sequence[str], most: int = 3) -> DataFrame:
    """Exons at most ``most`` apart on both axes made one."""
    w = Window.partitionBy(*ids).orderBy("est_start")
    near = (F.col("est_start") - F.lag("est_end").over(w) - 1 <= most) & (F.col("gen_start") - F.lag("gen_end").over(w) - 1 <= most)
    runs = rows.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*ids, F.col("_run").cast("int").alias("ord")).agg(*(f(c).alias(c) for f, c in ((F.min, "est_start"), (F.max, "est_end"), (F.min, "gen_start"), (F.max, "gen_end"))))


def _relation(a: list, b: list, site: int, out: int) -> str | None:
    """How chain b lies on chain a: equal, contained, contains or None."""
    if len(a) == 1 or len(b) == 1:
        if len(a) != len(b):
            return None
        (s, e), (x, y) = a[0], b[0]
        return "equal" if (s, e) == (x, y) else "contained" if s <= x and y <= e else "contains" if x <= s and e <= y else None
    if len(a) < len(b):
        back = _relation(b, a, site, out)
        return {"contained": "contains"}.get(back, back)
    near = lambda p, q: abs(p - q) <= site
    for k in range(len(a) - len(b) + 1):
        part = a[k : k + len(b)]
        if any(max(p[0], q[0]) > min(p[1], q[1]) for p, q in zip(part, b, strict=True)):
            continue
        inner = all(near(p[0], q[0]) and near(p[1], q[1]) for p, q in zip(part[1:-1], b[1:-1], strict=True))
        if not (inner and near(part[0][1], b[0][1]) and near(part[-1][0], b[-1][0])):
            continue
        left = k == 0 or part[0][0] - b[0][0] <= out
        right = k + len(b) == len(a) or b[-1][1] - part[-1][1] <= out
        if left and right:
            return "equal" if len(a) == len(b) else "contained"
    return None


def without_contained_alignments(rows: DataFrame, ids: Sequence[str], site: int = 50, out: int = 20) -> DataFrame:
    """Alignments of each transcript that no other one covers (P09), in their order:
    an equal one widens the outer ends of the one that stays, a contained one goes, and
    one that contains another takes its place. ``rows`` has ids, fact_no and exons, an
    array of structs (gen_start, gen_end); a transcript has few alignments, which are one
    row, and many transcripts are solved in a call."""

    def alone(facts: list[dict]) -> list[dict]:
        kept: list[list] = []
        for fact in facts:
            no, new, place = fact["fact_no"], [[e["gen_start"], e["gen_end"]] for e in fact["exons"]], None
            for old in list(kept):
                how = _relation(old[1], new, site, out)
                if how == "equal":
                    old[1][0][0], old[1][-1][1] = min(old[1][0][0], new[0][0]), max(old[1][-1][1], new[-1][1])
                if how in ("equal", "contained"):
                    place = old
                    break
                if how == "contains":
                    kept.remove(old)
            if place is None:
                kept.append([no, new])
        return [{"fact_no": no, "exons": [{"gen_start": s, "gen_end": e} for s, e in x]} for no, x in kept]

    kinds = rows.select("fact_no", "exons").schema

    @arrow_udf(f"array<{kinds.simpleString()}>")
    def solve(transcripts: pa.Array) -> pa.Array:
        return pa.array([alone(x) for x in transcripts.to_pylist()], transcripts.type)

    gathered = rows.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("fact_no", "exons"))).alias("_all"))
    return gathered.select(*ids, F.explode(solve("_all")).alias("_x")).select(*ids, "_x.fact_no", "_x.exons")


def polya_flags(uses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exons that end in poly-A: all their uses are last exons with a tail.
    ``uses`` has keys, gen_start, gen_end and tail."""
    return uses.groupBy(*keys, "gen_start", "gen_end").agg(F.bool_and("tail").alias("polya"))


def codons_agree(orfs: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether start and stop are the reference's on the genome (T10). Both have keys,
    gen_left and gen_right; orfs also tid and strand."""
    ref = reference.select(*keys, F.col("gen_left").alias("_l"), F.col("gen_right").alias("_r"))
    left, right = F.col("gen_left") == F.col("_l"), F.col("gen_right") == F.col("_r")
    plus = F.col("strand") >= 0
    return orfs.join(ref, list(keys)).select(*keys, "tid", F.when(plus, left).otherwise(right).alias("same_start"), F.when(plus, right).otherwise(left).alias("same_stop"))


def keep_richer_ends(ends: DataFrame, edge_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of end nodes with equal exons the one with more edges out (G13); ties: the
    lesser node. ``ends`` has keys, node and exons (any comparable form)."""
    out = edge_rows.groupBy(*keys, F.col("src").alias("node")).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "exons").orderBy(F.desc(F.coalesce("_n", F.lit(0))), "node"))
    return ends.join(out, [*keys, "node"], "left").withColumn("_r", rank).filter("_r = 1").drop("_n", "_r")
