"""Queries of the gene-structure operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain as together

from pyspark.sql import DataFrame, SparkSession

from . import queries_chain, queries_gene, queries_paths, queries_repair, queries_sequence

MODULES = (queries_sequence, queries_chain, queries_gene, queries_repair, queries_paths)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns with their support, from exon chains."""
    return queries_chain.QUERIES["j05_intron_support"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(together.from_iterable(m.QUERIES.items() for m in MODULES))


def oracle_sql() -> dict[str, str]:
    return dict(together.from_iterable(m.SQL.items() for m in MODULES))
