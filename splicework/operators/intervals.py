"""Interval operators: union, containment, covering. Ends are inclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def union(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping intervals of each key made one (W01). Intervals that only touch
    (next start = end + 1) stay apart. Columns: keys, start, end, members."""
    sort = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(sort.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= before, 0).otherwise(1)
    island = F.sum("_new").over(sort.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_new", new).withColumn("_island", island)
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("_island")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: Column, width: int, span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Rows of ``left`` (``span``) and ``right`` (r_start, r_end) of equal keys that
    overlap and satisfy ``on``. Coordinates are cut into bins of ``width``, so that the
    join is an equi-join on key and bin; a pair is kept in the first bin both have."""
    start, end = span
    a = left.withColumn("_bin", _bins(F.col(start), F.col(end), width))
    b = right.withColumn("_bin", _bins(F.col("r_start"), F.col("r_end"), width))
    first = F.col("_bin") == F.floor(F.greatest(start, "r_start") / width)
    hit = (F.col(start) <= F.col("r_end")) & (F.col("r_start") <= F.col(end))
    return a.join(b, [*keys, "_bin"]).filter(first & hit & on).drop("_bin")


def containing_window(factors: DataFrame, windows: DataFrame, keys: Sequence[str], width: int = 1024) -> DataFrame:
    """Each factor (start, end) with the window (r_start, r_end) that contains it
    (J04); windows of a key are disjoint, so there is at most one."""
    inside = (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end"))
    return overlap_join(factors, windows, keys, inside, width)


def cover_roots(df: DataFrame, keys: Sequence[str], ident: str = "id", width: int = 1024) -> DataFrame:
    """Each interval's root (J18): an interval that another contains points to the
    least id among those; roots are found by following the pointers in steps that
    double. Equal intervals point to the least id, and are compared as one, so that
    pairs grow with the different intervals of a key."""
    place = [*keys, "start", "end"]
    least = cut_lineage(df.groupBy(*place).agg(F.min(ident).alias("_least")))
    other = least.select(*keys, F.col("_least").alias("parent"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end"))
    proper = (F.col("r_start") < F.col("start")) | (F.col("end") < F.col("r_end"))
    over = overlap_join(least, other, keys, inside & proper, width).groupBy(*place).agg(F.min("parent").alias("_over"))
    own = F.when(F.col("_least") < F.col(ident), F.col("_least"))
    up = df.join(least, place).join(over, place, "left").select(*keys, ident, F.least(own, "_over").alias("up"))
    now = up.withColumn("root", F.coalesce("up", ident)).drop("up")
    while True:
        step = now.select(*keys, F.col(ident).alias("root"), F.col("root").alias("next"))
        moved = now.join(step, [*keys, "root"]).select(*keys, ident, F.col("next").alias("to"), "root")
        changed = moved.filter("to != root")
        now = cut_lineage(moved.select(*keys, ident, F.col("to").alias("root")))
        if changed.isEmpty():
            return now
