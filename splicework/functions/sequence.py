"""Sequence functions as column expressions. Coordinates are 1-based and inclusive."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Splice patterns (donor and acceptor) and how often each was observed.
PATTERN_FREQUENCY = (
    "AAAG=1 AAAT=1 AAGT=1 ACCC=1 AGAC=1 AGAG=5 AGCT=2 AGGC=1 AGTG=2 ATAA=1 ATAC=8 ATAG=7 ATAT=2 ATGC=1 ATGT=1 CAAG=1 CATT=1 CCAG=2 CGAG=1 CGCA=1 CTAC=2 CTCA=1 "
    "GAAG=8 GAGT=1 GATC=1 GATG=1 GCAG=126 GCGG=1 GCTA=1 GGAC=1 GGAG=11 GGCA=1 GGGA=2 GGTC=2 GTAG=200 GTAC=4 GTAT=2 GTCA=9 GTCG=4 GTCT=3 GTGC=1 GTGG=10 GTGT=1 GTTA=7 GTTC=2 GTTG=8 GTTT=2 "
    "TAAG=6 TACG=1 TATC=1 TCAG=1 TCGG=1 TGAC=1 TGAG=7 TGGG=2 TTAG=5 TTAT=1 TTGG=1"
)
FREQUENCIES = {p: int(n) for p, n in (x.split("=") for x in PATTERN_FREQUENCY.split())}

STOPS = ("TAA", "TAG", "TGA")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq) -> Column:
    """IUPAC pairs, case kept; other characters stay."""
    return F.reverse(F.translate(_col(seq), "ACGTRYMKBVDHacgtrymkbvdh", "TGCAYRKMVBHDtgcayrkmvbhd"))


def trim_n(seq) -> Column:
    """struct<seq, pref_n, suff_n>: N at both ends cut and counted (F03). A text of
    N only is all prefix."""
    s = _col(seq)
    lead = F.length(F.regexp_extract(s, "^(N*)", 1))
    rest = F.regexp_replace(s, "^N+", "")
    return F.struct(F.regexp_replace(rest, "N+$", "").alias("seq"), lead.alias("pref_n"), F.length(F.regexp_extract(rest, "(N*)$", 1)).alias("suff_n"))


def substring0(seq, start, length) -> Column:
    """0-based substring; a negative start shortens it."""
    start, length = _col(start), _col(length)
    return F.substring(_col(seq), F.greatest(start, F.lit(0)) + 1, F.greatest(length + F.least(start, F.lit(0)), F.lit(0)))


_BASE_CODE = np.full(256, 4, np.uint8)
for _k, _base in enumerate("ACGT"):
    _BASE_CODE[[ord(_base), ord(_base.lower())]] = _k


def _dust(text: str) -> float:
    if len(text) <= 2:
        return 0.0
    c = _BASE_CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)].astype(np.int64)
    pair = np.where((c[:-1] < 4) & (c[1:] < 4), 4 * c[:-1] + c[1:], 16)
    n = np.bincount(pair, minlength=17)
    return 10.0 * int((n * (n - 1) // 2).sum()) / (len(text) - 2) / len(text)


def dust_score(seq) -> Column:
    """Low complexity (F06): ten times the pairs of equal dinucleotides, by length;
    pairs with other letters share one class. 0 up to length 2."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([np.nan if t is None else _dust(t) for t in texts], dtype=float)

    return F.nullif(score(_col(seq)), F.lit(float("nan")))


def dust_scores(seqs) -> Column:
    """``dust_score`` of each text of an array."""

    @F.pandas_udf("array<double>")
    def score(arrays: pd.Series) -> pd.Series:
        return pd.Series([[_dust(t or "") for t in texts] for texts in arrays])

    return score(_col(seqs))


def pattern_frequency(donor, acceptor) -> Column:
    """Observed frequency of a splice pattern, any case; 0 if unknown."""
    table = F.create_map(*(F.lit(x) for kv in FREQUENCIES.items() for x in kv))
    return F.coalesce(table[F.upper(F.concat(_col(donor), _col(acceptor)))], F.lit(0))


def is_canonical(intron) -> Column:
    """GT ... AG in one case."""
    return _col(intron).rlike("^(?s:GT.*AG|gt.*ag)$")


def polya_signal(unaligned, genome, end) -> Column:
    """struct<polya, pas>: a poly-A tail of 8 or more and one more base at the start of
    the unaligned suffix; a PAS starting in the last 40 genomic bases up to ``end``
    (1-based). The tail is retracted where the genome itself is rich in A (F08)."""
    tail = _col(unaligned).rlike("^A{8,}.") & (F.length(F.regexp_extract(_col(unaligned), "^(A*)", 1)) < F.length(_col(unaligned)))
    g, end = _col(genome), _col(end)
    last = F.substring(g, F.greatest(end - 39, F.lit(1)), F.least(F.lit(40), end) + 5)
    near = F.substring(g, F.greatest(end - 8, F.lit(1)), F.lit(20))
    after = F.substring(g, end + 1, F.lit(10))
    rich = near.rlike("A{6}") | (F.length(F.regexp_replace(after, "[^A]", "")) >= 7)
    return F.struct((tail & ~rich).alias("polya"), last.rlike("AATAAA|ATTAAA").alias("pas"))


def edit_distance(a, b) -> Column:
    """Unit costs, no wildcard."""
    return F.levenshtein(_col(a), _col(b))


def within_edits(a, b, k: int) -> Column:
    """Whether the edit distance is at most ``k`` (F16); the banded form of F15."""
    return F.levenshtein(_col(a), _col(b), k) >= 0


def lift(strand, abs_start, abs_end, start, end) -> Column:
    """struct<start, end> on the chromosome."""
    plus = F.struct((_col(abs_start) + _col(start) - 1).alias("start"), (_col(abs_start) + _col(end) - 1).alias("end"))
    minus = F.struct((_col(abs_end) - _col(end) + 1).alias("start"), (_col(abs_end) - _col(start) + 1).alias("end"))
    return F.when(_col(strand) >= 0, plus).otherwise(minus)


def junction_repeat(genome, left, right) -> Column:
    """The longest identical run that ends before the intron [left, right] and at its
    end, and the one that starts at both starts; '.' if both are empty (F23)."""
    g, left, right = _col(genome), _col(left), _col(right)
    most = F.least(left - 1, right - left + 1)
    back = lambda at, k: F.substring(g, at - k + 1, k)
    before = F.aggregate(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), F.lit(0), lambda best, k: F.when(back(left - 1, k) == back(right, k), F.greatest(best, k)).otherwise(best))
    ahead = F.least(right - left + 1, F.length(g) - right)
    after = F.aggregate(F.sequence(F.lit(0), F.greatest(ahead, F.lit(0))), F.lit(0), lambda best, k: F.when(F.substring(g, left, k) == F.substring(g, right + 1, k), F.greatest(best, k)).otherwise(best))
    text = F.concat(back(left - 1, before), F.substring(g, left, after))
    return F.when(F.length(text) > 0, text).otherwise(F.lit("."))


def is_start(codon) -> Column:
    return F.upper(_col(codon)) == "ATG"


def is_stop(codon) -> Column:
    return F.upper(_col(codon)).isin(*STOPS)


def kozak_context(seq, pos) -> Column:
    """2 less one for each of pos - 3 and pos + 3 that isn't A or G."""
    fine = lambda at: F.upper(F.substring(_col(seq), at, F.lit(1))).isin("A", "G").cast("int")
    return fine(_col(pos) - 3) + fine(_col(pos) + 3)


def alpha_label(n) -> Column:
    """1 is a, 26 is z, 27 is aa."""
    digit = lambda x: F.chr((F.pmod(x - 1, F.lit(26)) + 97).cast("bigint"))
    up = lambda x: F.floor((x - 1) / 26).cast("bigint")
    n = _col(n).cast("bigint")
    one, two = up(n), up(up(n))
    return F.concat(F.when(two > 0, digit(two)).otherwise(""), F.when(one > 0, digit(one)).otherwise(""), digit(n))


def allowed_errors(length) -> Column:
    """Edits that an exon may have."""
    n = _col(length)
    rate = F.when(n > 100, 0.03).when(n > 50, 0.035).otherwise(0.04)
    return F.greatest(F.lit(1), F.ceil(n * rate)).cast("int")


def flanks(genome, start, end) -> Column:
    """Context of an intron [start, end] (F29): 15-base exon flanks, 20-base ends."""
    g, start, end = _col(genome), _col(start), _col(end)
    left = F.greatest(start - 15, F.lit(1))
    low = F.greatest(end - 19, start)
    return F.struct(
        F.substring(g, left, start - left).alias("donor_suffix"),
        F.substring(g, start, F.least(F.lit(20), end - start + 1)).alias("intron_prefix"),
        F.substring(g, low, end - low + 1).alias("intron_suffix"),
        F.substring(g, end + 1, F.lit(15)).alias("acceptor_prefix"),
        F.concat(F.substring(g, start, F.lit(2)), F.substring(g, end - 1, F.lit(2))).alias("pattern"),
    )
