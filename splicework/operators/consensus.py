"""Agreement of introns with better ones near them.

Introns are rows (key, i_start, i_end, agree_type, frequency, support): type 0 for
RefSeq, 1 for canonical, 2 for others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import pattern_frequency


def agree_type(refseq: Column, pattern: Column, kind: Column) -> Column:
    """0 RefSeq, 1 GT-AG, GC-AG or AT-AC with a class, 2 other."""
    return F.when(refseq, 0).when(pattern.isin("GTAG", "GCAG", "ATAC") & (kind != "ND"), 1).otherwise(2)


def band_join(introns: DataFrame, targets: DataFrame, keys: Sequence[str], band: int) -> DataFrame:
    """Each intron with the targets whose ends are both nearer than ``band``, as
    t_start and t_end. The starts are cut into bins of ``band``: an equi-join on three
    neighbouring bins."""
    a = introns.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("i_start") / band) + d)))
    b = targets.withColumn("_bin", F.floor(F.col("t_start") / band))
    near = (F.abs(F.col("t_start") - F.col("i_start")) < band) & (F.abs(F.col("t_end") - F.col("i_end")) < band)
    other = (F.col("t_start") != F.col("i_start")) | (F.col("t_end") != F.col("i_end"))
    return a.join(b, [*keys, "_bin"]).filter(near & other).drop("_bin")


def targets_in_order(pairs: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The targets of each intron with their ``rank`` in the order."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "i_start", "i_end").orderBy(*order, "t_start", "t_end")))


def first_target(pairs: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One target of each intron: the first in the order."""
    return targets_in_order(pairs, keys, *order).filter("rank = 1").drop("rank")


def _targets(introns: DataFrame, keys: Sequence[str]) -> DataFrame:
    return introns.select(*keys, F.col("i_start").alias("t_start"), F.col("i_end").alias("t_end"), F.col("agree_type").alias("t_type"), F.col("frequency").alias("t_frequency"), F.col("support").alias("t_support"))


def agree_with_reference(introns: DataFrame, keys: Sequence[str], band: int = 12, choose: Callable = first_target) -> DataFrame:
    """Canonical introns to RefSeq ones (J06). ``choose`` is first_target, or
    targets_in_order where a read takes the first one that its bases allow."""
    return choose(band_join(introns.filter("agree_type = 1"), _targets(introns, keys).filter("t_type = 0"), keys, band), keys)


def agree_with_better(introns: DataFrame, keys: Sequence[str], kind: int, band: int = 12, choose: Callable = first_target) -> DataFrame:
    """Introns of a type to those of the same type with a more frequent pattern (J07
    for canonical ones, J10 for others)."""
    pairs = band_join(introns.filter(F.col("agree_type") == kind), _targets(introns, keys).filter(F.col("t_type") == kind), keys, band)
    return choose(pairs.filter("t_frequency > frequency AND t_support > 0"), keys, F.desc("t_frequency"))


def agree_with_any(introns: DataFrame, keys: Sequence[str], band: int = 12, choose: Callable = first_target) -> DataFrame:
    """Other introns to RefSeq ones, else to canonical ones."""
    pairs = band_join(introns.filter("agree_type = 2"), _targets(introns, keys).filter("t_type < 2 AND t_support > 0"), keys, band)
    return choose(pairs, keys, F.col("t_type"))


def after_agreement(introns: DataFrame, moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Support per intron once the agreed ones moved to their targets, counted anew."""
    to = moves.select(*keys, "i_start", "i_end", "t_start", "t_end")
    placed = introns.join(to, [*keys, "i_start", "i_end"], "left")
    return placed.groupBy(*keys, F.coalesce("t_start", "i_start").alias("i_start"), F.coalesce("t_end", "i_end").alias("i_end")).agg(F.sum("support").alias("support"))


def single_site(rows: DataFrame, ids: Sequence[str], band: int = 16, fix: str = "donor", genome: str = "genome") -> DataFrame:
    """The other end, nearer than ``band``, that gives the most frequent pattern while
    one site stays (J09), if it is better than the present one: new_start, new_end."""
    shift = F.explode(F.sequence(F.lit(1 - band), F.lit(band - 1)))
    tried = rows.withColumn("_d", shift)
    start = F.col("i_start") if fix == "donor" else F.col("i_start") + F.col("_d")
    end = F.col("i_end") + F.col("_d") if fix == "donor" else F.col("i_end")
    return _best_pattern(tried.withColumn("new_start", start).withColumn("new_end", end), ids, genome, F.abs("_d"))


def nearby(rows: DataFrame, ids: Sequence[str], reach: int = 3, genome: str = "genome") -> DataFrame:
    """The most frequent pattern with both ends moved by up to ``reach``."""
    shifts = F.sequence(F.lit(-reach), F.lit(reach))
    tried = rows.withColumn("_a", F.explode(shifts)).withColumn("_b", F.explode(shifts))
    return _best_pattern(tried.withColumn("new_start", F.col("i_start") + F.col("_a")).withColumn("new_end", F.col("i_end") + F.col("_b")), ids, genome, F.abs("_a") + F.abs("_b"))


def _best_pattern(tried: DataFrame, ids: Sequence[str], genome: str, moved: Column) -> DataFrame:
    two = lambda at: F.substring(F.col(genome), at, F.lit(2))
    now = pattern_frequency(two(F.col("i_start")), two(F.col("i_end") - 1))
    new = pattern_frequency(two(F.col("new_start")), two(F.col("new_end") - 1))
    fine = (F.col("new_start") >= 1) & (F.col("new_end") <= F.length(genome)) & (F.col("new_start") < F.col("new_end"))
    better = tried.filter(fine).withColumn("old_frequency", now).withColumn("new_frequency", new).withColumn("_moved", moved).filter("new_frequency > old_frequency")
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy(F.desc("new_frequency"), "_moved", "new_start", "new_end"))
    return better.withColumn("_r", rank).filter("_r = 1").select(*ids, "new_start", "new_end", "old_frequency", "new_frequency")
