"""Incidence of alignments on exon windows, and the least cover.

Input rows: (key, tid, alt, window): alternative ``alt`` of transcript ``tid`` uses the
window. A cover is a set of windows that holds all windows of one alternative of
each transcript.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache, reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def incidence(factors: DataFrame, keys: list[str]) -> DataFrame:
    """The windows of each alternative as one sorted array."""
    return factors.groupBy(*keys, "tid", "alt").agg(F.array_sort(F.collect_set("window")).alias("windows"))


def essential_windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that all alternatives of some transcript use."""
    alternatives = rows.groupBy(*keys, "tid").agg(F.count_distinct("alt").alias("n_alts"))
    uses = rows.groupBy(*keys, "tid", "window").agg(F.count_distinct("alt").alias("uses"))
    return uses.join(alternatives, [*keys, "tid"]).filter("uses = n_alts").select(*keys, "window").distinct()


@lru_cache(maxsize=1 << 14)
def _search(options: Iterable[Sequence[int]]) -> int:
    """The least set of windows that holds an alternative of each transcript; of equally
    small ones the first in order. Sets of windows are bits of a number, the first window
    the lowest. Windows that all alternatives of a transcript use are taken first, and what
    is left is searched. Branch and bound: the transcript with the fewest ways left is
    decided first, and transcripts whose ways share no window add up to a bound."""

    def missing(ways_of: Iterable[Sequence[int]], have: int, allowed: int) -> list[list[int]] | None:
        """What each open transcript may still add; None if one can't be held."""
        out = []
        for ways in ways_of:
            left = sorted({w & ~have for w in ways}, key=lambda w: (w.bit_count(), w))
            if not left[0]:
                continue
            least: list[int] = []
            for w in left:
                if not w & ~allowed and all(v & ~w for v in least):
                    least.append(w)
            if not least:
                return None
            out.append(least)
        return out

    def bound(open_: list[list[int]]) -> int:
        seen, total = 0, 0
        for ways in sorted(open_, key=lambda x: -x[0].bit_count()):
            windows = reduce(or_, ways)
            if not windows & seen:
                seen |= windows
                total += ways[0].bit_count()
        return total

    def possible(have: int, allowed: int, most: int) -> bool:
        open_ = missing(left, have, allowed)
        if open_ is None:
            return False
        if not open_:
            return have.bit_count() <= most
        if have.bit_count() + bound(open_) > most:
            return False
        return any(possible(have | w, allowed, most) for w in min(open_, key=len))

    have, left = 0, missing(options, 0, -1) or []
    while needed := reduce(or_, (reduce(and_, ways) for ways in left), 0):
        have, left = have | needed, missing(left, needed, -1) or []
    if not left:
        return have
    every, size = reduce(or_, (w for ways in left for w in ways)), bound(left)
    while not possible(0, -1, size):
        size += 1
    found = 0
    while every and found.bit_count() < size:
        low = every & -every
        every ^= low
        if possible(found | low, -low, size):
            found |= low
    return have | found


def minimum_cover(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window, status): the exact least cover of each key (G05), whatever its size.
    Equal alternatives of a transcript and transcripts with equal alternatives are one; a
    key's problem is one row, and many are solved in a call, equal ones once in a row."""
    kind = rows.schema["window"].dataType.simpleString()
    ways = rows.groupBy(*keys, "tid", "alt").agg(F.array_sort(F.collect_set("window")).alias("ways"))
    options = ways.groupBy(*keys, "tid").agg(F.array_sort(F.collect_set("ways")).alias("ways"))
    problems = options.groupBy(*keys).agg(F.collect_set("ways").alias("options"))

    def cover(options: list[list[list]]) -> list:
        windows = sorted({w for ways in options for way in ways for w in way})
        bit = {w: 1 << i for i, w in enumerate(windows)}
        have = _search(frozenset(frozenset(sum(map(bit.__getitem__, way)) for way in ways) for ways in options))
        return [w for w in windows if have & bit[w]]

    @arrow_udf(f"array<{kind}>")
    def solve(options: pa.Array) -> pa.Array:
        return pa.array([cover(x) for x in options.to_pylist()], pa.list_(options.type.value_type.value_type.value_type))

    return problems.select(*keys, F.explode(solve("options")).alias("window"), F.lit("exact").alias("status"))


def chosen_alternative(rows: DataFrame, cover: DataFrame, keys: list[str]) -> DataFrame:
    """Alternatives that the cover holds (for A09)."""
    have = cover.select(*keys, "window").withColumn("_in", F.lit(1))
    held = rows.join(have, [*keys, "window"], "left").groupBy(*keys, "tid", "alt").agg(F.count("*").alias("n_windows"), F.count("_in").alias("_n"))
    return held.filter("n_windows = _n").drop("_n")
