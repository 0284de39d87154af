"""Intron support of a stream of reads: a state of counts by intron."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_support(introns: DataFrame, keys: list[str]) -> DataFrame:
    """Support so far of each intron (for output mode update or complete)."""
    return introns.groupBy(*keys, "i_start", "i_end").agg(F.count("*").alias("support"))


def windowed_support(introns: DataFrame, keys: list[str], time: str, window: str, late: str) -> DataFrame:
    """Support in each window of event time; rows later than ``late`` are dropped."""
    return introns.withWatermark(time, late).groupBy(F.window(time, window), *keys, "i_start", "i_end").agg(F.count("*").alias("support"))
