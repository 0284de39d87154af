"""Splice-site scores by position weight matrices, and intron classes.

Matrices are a table (matrix, pos from 0, base, p) that the caller loads, with one row
per cell; a cell gets the pseudo-count 1e-5.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PSEUDO = 1e-5
#: A branch point must score more than this.
BRANCH_POINT = 0.75


def read_matrices(spark, path: str) -> DataFrame:
    """The matrices of a CSV file matrix,pos,base,p."""
    return spark.read.schema("matrix int, pos int, base string, p double").option("header", True).csv(path)


def weights(pwm: DataFrame) -> DataFrame:
    """(matrix, pos, base, value): what a base adds to the score, as a share of the
    matrix's highest score. A column counts by its information."""
    p = F.col("p") + PSEUDO
    column = pwm.groupBy("matrix", "pos").agg((F.lit(100) / F.log(F.lit(5.0)) * (F.sum(p * F.log(p)) + F.log(F.lit(5.0)))).alias("c"), F.max(p).alias("top"))
    most = column.groupBy("matrix").agg(F.sum(F.col("c") * F.col("top")).alias("most"))
    return pwm.join(column, ["matrix", "pos"]).join(most, "matrix").select("matrix", "pos", "base", (F.col("c") * p / F.col("most")).alias("value"))


def log_odds(pwm: DataFrame) -> DataFrame:
    """log2 of each cell against an even background."""
    return pwm.withColumn("lod", F.log2((F.col("p") + PSEUDO) / 0.25))


def _letters(rows: DataFrame, ids: Sequence[str], motif: str) -> DataFrame:
    """Bases by position; N counts as A."""
    base = F.regexp_replace(F.upper(F.col(motif)), "[^ACGT]", "A")
    return rows.select(*ids, "matrix", F.posexplode(F.filter(F.split(base, ""), lambda x: x != "")).alias("pos", "base"))


def pwm_scores(motifs: DataFrame, pwm: DataFrame, ids: Sequence[str], motif: str = "motif") -> DataFrame:
    """The score of each motif under its matrix."""
    return _letters(motifs, ids, motif).join(weights(pwm), ["matrix", "pos", "base"]).groupBy(*ids, "matrix").agg(F.sum("value").alias("score"))


def site_scores(introns: DataFrame, pwm: DataFrame, ids: Sequence[str], matrices: dict[str, tuple[int, int, int]], genome: str = "genome") -> DataFrame:
    """A column for each named scorer (F09a): (matrix, width, offset of the window's
    start from the intron's start; negative widths count from its end)."""
    out = introns
    for name, (matrix, width, offset) in matrices.items():
        at = F.col("i_start") + offset if width > 0 else F.col("i_end") + offset
        one = introns.select(*ids, F.lit(matrix).alias("matrix"), F.substring(F.col(genome), at, F.lit(abs(width))).alias("motif"))
        out = out.join(pwm_scores(one, pwm, ids).select(*ids, F.col("score").alias(name)), list(ids), "left")
    return out


def best_window(rows: DataFrame, pwm: DataFrame, ids: Sequence[str], width: int, first: Column, last: Column, seq: str = "seq") -> DataFrame:
    """position and score of the best window that starts in first .. last (1-based); of
    equal scores, to nine digits, the last (F11)."""
    cells = weights(pwm).withColumn("cell", F.col("pos") * 4 + F.instr(F.lit("ACGT"), F.col("base")) - 1)
    flat = cells.groupBy("matrix").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda c: c["value"]).alias("_w"))
    code = np.zeros(256, np.int64)  # N, and all else, counts as A
    for k, base in enumerate("ACGT"):
        code[[ord(base), ord(base.lower())]] = k

    @F.pandas_udf("position int, score double")
    def best(texts: pd.Series, w: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        out = []
        for t, weight, a, b in zip(texts, w, lo, hi, strict=True):
            c = code[np.frombuffer(t.encode("ascii", "replace")[a - 1 : b + width - 1], np.uint8)]
            n = len(c) - width + 1
            if n < 1:
                out.append((None, None))
                continue
            cell = np.asarray(weight).reshape(width, 4)
            total = np.zeros(n)
            for i in range(width):
                total += cell[i][c[i : i + n]]
            total = np.round(total, 9)
            at = n - 1 - int(np.argmax(total[::-1]))
            out.append((a + at, float(total[at])))
        return pd.DataFrame(out, columns=["position", "score"]).astype({"position": "Int32", "score": float})

    return rows.join(flat, "matrix").select(*ids, "matrix", best(F.col(seq), "_w", first, last).alias("_b")).select(*ids, "matrix", "_b.position", "_b.score").filter("position IS NOT NULL")


def intron_class(pattern: Column, branch_score: Column, u12: Column, u2: Column) -> Column:
    """U12, U2 or ND (F12) from the pattern, the best branch point's score and the two
    donor scores."""
    found = branch_score > BRANCH_POINT
    known = pattern.isin("GTAG", "GCAG")
    other = ~pattern.isin("GTAG", "GCAG", "ATAC")
    return F.when(found, F.when(u12 > u2, "U12").otherwise("U2")).when(known, "U2").when(other & (u12 - u2 > 0.25) & (u12 >= 0.75), "U12").otherwise("ND")
