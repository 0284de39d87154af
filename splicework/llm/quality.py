"""Quality rules: plain word statistics and robust multivariate outliers.

``statistics`` counts words, symbols, repeated lines and repeated 3-word windows of
every whole text. Texts that pass the base rule are then judged by the distance of
their transformed statistics from the centre of their language and source, under a
minimum-covariance-determinant estimate: from each of three deterministic starts,
concentration steps keep the h = 75 % nearest rows of each group and re-estimate mean
and covariance from them, which lowers the determinant each time; the start with the
least determinant goes on until it settles, and a reweighting step follows. All steps
are grouped aggregations over a narrow table.
Estimates are made for (language, source), language and all rows, and each is shrunk
to the next wider one by PRIOR_ROWS, so that small sources are judged too. A floor on
the standard deviation of each statistic keeps covariances regular where most rows
have the same value.

Defined cases: a null text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows all count; ties at the quantile are all
kept in a step; an empty table gives an empty result; columns of the input other than
id, text, language and source are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stash
from .textops import SPACE_WORDS, Slice, counts_between, lut, pair_hash, slices, span_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of rows in a concentration step, and in the first one from each start.
H, FIRST_H = 0.75, 0.5
#: Steps of all starts, before the best of each group goes on alone.
FIRST_STEPS = 3
#: What a log determinant may still fall by in the last step, and a bound on the steps.
SETTLED, MOST_STEPS = 1e-3, 30
PRIOR_ROWS = 50
#: A clean row is rejected about this often if statistics are normal.
TAIL = 1e-6
REWEIGHT_TAIL = 0.025
#: Least standard deviation of each transformed statistic, in its own unit. For the
#: shares of repeated lines and words it is the sampling error of a share's square root,
#: 0.5 / sqrt(n), of 25 lines and of MIN_WORDS words: enough to keep covariances regular,
#: and so little that an outlier in one statistic alone can be rejected.
FLOORS = (0.5, 0.06, 0.09, 0.5 / math.sqrt(25), 0.5 / math.sqrt(MIN_WORDS))
P = len(FLOORS)
#: Up to so many groups, of a few hundred bytes each, estimates are broadcast; more
#: are joined.
FEW_GROUPS = 20_000

_SYMBOLS = lut(b"#*$%&|<>")
_STATS = "id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the counts of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                counts = _count(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), part.column("source"), *(pa.array(c, pa.int64()) for c in counts)], [c.split()[0] for c in _STATS.split(", ")])

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(rows, _STATS)


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which members occur more than once."""
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def _count(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    s = Slice(texts, False, SPACE_WORDS)
    starts_char = (s.raw & 0xC0) != 0x80
    word_chars = counts_between(s.is_word & starts_char, s.first)
    n_symbols = counts_between(_SYMBOLS[s.raw], s.first)
    # lines: the newline after each text ends its last line
    end = np.flatnonzero(s.raw == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    doc = np.searchsorted(s.first, start, "right") - 1
    with_word = counts_between(s.is_word, np.append(start, len(s.raw))) > 0
    doc, lines = doc[with_word], span_hashes(s.raw, start[with_word], end[with_word])
    _, first = np.unique(pair_hash(lines, doc.astype(np.uint64)), return_index=True)
    n_lines = np.bincount(doc, minlength=len(s))
    n_dup = n_lines - np.bincount(doc[first], minlength=len(s))
    # words in 3-word windows found twice or more
    words, of = s.hashes(), s.doc_of_word()
    covered = np.zeros(len(words) + 2, bool)
    if len(words) > 2:
        window = pair_hash(pair_hash(words[:-2], words[1:-1]), words[2:])
        window = pair_hash(window, of[:-2].astype(np.uint64))
        twice = np.zeros(len(window), bool)
        inside = np.flatnonzero(of[:-2] == of[2:])
        twice[inside] = _repeats(window[inside])
        for k in range(3):
            covered[k : k + len(window)] |= twice
    n_repeat = counts_between(covered[: len(words)], s.word_first)
    return s.n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def transformed() -> list[Column]:
    """Logarithms of length and word length, square roots of the shares."""
    share = lambda c, of: F.sqrt(F.col(c) / F.greatest(F.col(of), F.lit(1)))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def _gamma_p(a: float, x: float) -> float:
    """The regularized lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_cdf(x: float, k: int) -> float:
    return _gamma_p(k / 2, x / 2) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def _consistency(share: float) -> float:
    """What a covariance of the nearest ``share`` of normal rows is to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _group(level: int) -> Column:
    name = lambda c, used: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n")) if used else F.lit("")
    return F.concat_ws("\u0000", F.lit(str(level)), name("lang", level < 2), name("source", level < 1))


def _distance() -> Column:
    """The squared Mahalanobis distance of x from mean under precision (row by row)."""
    d = [F.col("x")[i] - F.col("mean")[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col("precision")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))


_ESTIMATE = "g string, start int, n bigint, mean array<double>, cov array<double>, precision array<double>, logdet double"


def _solved(g, start, n, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Estimates with the inverse and the log determinant of their floored covariances."""
    floored = cov + np.diag(np.square(FLOORS))
    flat = lambda x: list(x.reshape(-1, P * P))
    return pd.DataFrame({"g": g, "start": start, "n": n, "mean": list(mean), "cov": flat(cov), "precision": flat(np.linalg.inv(floored)), "logdet": np.linalg.slogdet(floored)[1]})


def _matrices(column: pd.Series, *shape: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, *shape)


def _moments(rows: DataFrame) -> DataFrame:
    """n, s (sums of x) and q (sums of products, row by row) of each group and start."""
    s = F.array(*(F.sum(F.col("x")[i]) for i in range(P)))
    q = [[F.sum(F.col("x")[min(i, j)] * F.col("x")[max(i, j)]) for j in range(P)] for i in range(P)]
    return rows.groupBy("g", "start").agg(F.count("*").alias("n"), s.alias("s"), F.array(*(c for r in q for c in r)).alias("q"))


def _estimates(rows: DataFrame, factor: float) -> DataFrame:
    """Mean, covariance and its inverse of each group and start."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["n"].to_numpy(float)[:, None]
            mean = _matrices(f["s"], P) / n
            cov = (_matrices(f["q"], P, P) / n[:, :, None] - mean[:, :, None] * mean[:, None, :]) * factor
            yield _solved(f["g"], f["start"], f["n"], mean, cov)

    return stash(_moments(rows).mapInPandas(solve, _ESTIMATE), "mcd-step")


def _sender(long: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts tables with a row for each group (and start) while groups are few."""
    return F.broadcast if long.select("g").distinct().count() <= FEW_GROUPS else lambda df: df


def _starts(long: DataFrame, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Three first estimates of each group, at the medians: spreads alone (median absolute
    deviations), and those with the shape of spatial signs or of hyperbolic tangents."""
    x = lambda i: F.col("x")[i]
    middle = long.groupBy("g").agg(F.array(*(F.percentile_approx(x(i), 0.5) for i in range(P))).alias("mean"))
    scale = F.array(*(F.sqrt((F.percentile_approx(F.abs(x(i) - F.col("mean")[i]), 0.5) * 1.4826) ** 2 + FLOORS[i] ** 2) for i in range(P)))
    spread = stash(long.join(send(middle), "g").groupBy("g").agg(scale.alias("scale"), F.first("mean").alias("mean")), "mcd-spread")
    z = [(x(i) - F.col("mean")[i]) / F.col("scale")[i] for i in range(P)]
    length = F.greatest(F.sqrt(sum((v * v for v in z), F.lit(0.0))), F.lit(1e-300))
    shapes = F.array(*(F.struct(F.lit(k).alias("start"), F.array(*y).alias("x")) for k, y in ((1, [v / length for v in z]), (2, [F.tanh(v) for v in z]))))
    moments = _moments(long.join(send(spread), "g").select("g", F.inline(shapes))).select("g", "start", "n", "q")
    unit = F.array(*(F.lit(float(i == j)) for i in range(P) for j in range(P)))
    every = moments.unionByName(spread.select("g", F.lit(0).alias("start"), F.lit(1).cast("bigint").alias("n"), unit.alias("q")))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scale, shape = _matrices(f["scale"], P), _matrices(f["q"], P, P)
            trace = np.trace(shape, axis1=1, axis2=2)[:, None, None]
            yield _solved(f["g"], f["start"], f["n"], _matrices(f["mean"], P), shape * P / np.maximum(trace, 1e-300) * scale[:, :, None] * scale[:, None, :])

    first = stash(every.join(send(spread), "g").mapInPandas(solve, _ESTIMATE), "mcd-start")
    discard(spread)
    return first


def concentrate(long: DataFrame) -> DataFrame:
    """The estimate of least determinant of each group: rows (g, x) to _ESTIMATE. Each step
    keeps the H nearest rows (the first one FIRST_H), so the determinant falls; after
    FIRST_STEPS the best start of each group goes on until no group's log determinant falls
    by more than SETTLED. That is a least one among near subsets; among all subsets it is
    the least where outliers stand apart, but nothing proves it."""
    send = _sender(long)

    def step(now: DataFrame, share: float = H) -> DataFrame:
        near = long.join(send(now.select("g", "start", "mean", "precision")), "g").select("g", "start", "x", _distance().alias("d"))
        limit = near.groupBy("g", "start").agg(F.percentile_approx("d", share).alias("limit"))
        return _estimates(near.join(send(limit), ["g", "start"]).filter("d <= limit"), _consistency(share))

    now = _starts(long, send)
    for k in range(FIRST_STEPS):
        last, now = now, step(now, H if k else FIRST_H)
        discard(last)
    best = F.min_by(F.struct(*now.columns), F.struct("logdet", "start")).alias("best")
    last, now = now, stash(now.groupBy("g").agg(best).select("best.*"), "mcd-best")
    discard(last)
    for _ in range(MOST_STEPS):
        last, now = now, step(now)
        fall = last.join(now.select("g", F.col("logdet").alias("least")), "g").agg(F.max(F.col("logdet") - F.col("least"))).first()[0]
        discard(last)
        if fall is None or fall <= SETTLED:
            break
    return now


def fit(rows: DataFrame) -> DataFrame:
    """The estimate of every (language, source). ``rows`` has lang, source and x."""
    long = stash(rows.select("x", F.explode(F.array(*(_group(k) for k in range(3)))).alias("g")), "mcd-rows")
    raw = concentrate(long)
    near = long.join(_sender(long)(raw.select("g", "start", "mean", "precision")), "g").filter(_distance() <= chi2_quantile(1 - REWEIGHT_TAIL, P))
    now = _estimates(near.select("g", "start", "x"), _consistency(1 - REWEIGHT_TAIL))
    discard(long, raw)
    level = lambda k: now.filter(F.col("g").startswith(f"{k}"))
    keys = rows.select("lang", "source", _group(0).alias("g"), _group(1).alias("g1"), _group(2).alias("g2")).distinct()
    wide = keys
    for k, name in enumerate(("g", "g1", "g2")):
        wide = wide.join(level(k).select(F.col("g").alias(name), *(F.col(c).alias(f"{c}{k}") for c in ("n", "mean", "cov"))), name, "left")

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            mean = cov = None
            for k in (2, 1, 0):
                n = f[f"n{k}"].fillna(0).to_numpy(float)[:, None]
                have = lambda c, size: np.array([x if x is not None else np.zeros(size) for x in f[c]], float)  # noqa: B023, E731
                own, own_cov = have(f"mean{k}", P), have(f"cov{k}", P * P)
                share = np.ones_like(n) if mean is None else n / (n + PRIOR_ROWS)
                mean = own * share + (0 if mean is None else mean * (1 - share))
                cov = own_cov * share + (0 if cov is None else cov * (1 - share))
            yield _solved(f["g"], 0, f["n0"].fillna(0).astype("int64"), mean, cov.reshape(-1, P, P))

    return wide.mapInPandas(shrink, _ESTIMATE)


@small_batches
def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The statistics, the base rule's and the final verdict and the squared distance
    (null where the base rule failed) of every row."""
    stats = stash(statistics(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", base_failed()).withColumn("x", F.array(*transformed())), "statistics")
    model = stash(fit(stats.filter("NOT base_failed")), "mcd")
    far = chi2_quantile(1 - TAIL, P)
    distance = F.when(~F.col("base_failed"), _distance())
    return (
        stats.withColumn("g", _group(0))
        .join(model.select("g", "mean", "precision"), "g", "left")
        .withColumn("distance", distance)
        .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= far)).alias("kept"), "distance")
    )
