"""Queries of paths and of what is done to an alignment afterwards.

Alignments are derived: each document's bases are cut, over their whole length, into pieces
of PIECE; two introns with known ends are put between three thirds of a piece (a piece too
short for that is one exon), and the read is the thirds joined. What a query looks for is
then planted by document and piece. They have no SQL: ``tests/test_paths.py`` compares the
operators with plain versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths, small_exons, splices
from ..session import cut_lineage
from . import pipeline
from .queries_sequence import K, _pairings
from .tables import sequences

QUERIES, SQL = {}, {}
#: Bases of a piece, bases of an intron besides its ends, and the least third.
PIECE, INNER, THIRD = 240, 60, 40


def query(f):
    QUERIES[f.__name__] = f
    return f


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal paths of each transcript of a locus; graphs that are too complex are built
    from longer seeds."""
    rows = sequences(spark, sf_dir)
    genome = rows.filter("doc_id % 10 = 0").select(F.floor(F.col("doc_id") / 10).alias("locus"), "seq")
    length = rows.select(F.col("doc_id").alias("est_id"), F.length("seq").alias("length"))
    kept, linked = pipeline.graph(cut_lineage(_pairings(spark, sf_dir).drop("gen_id").join(length, "est_id")), pipeline.Config(min_factor_length=K))
    return paths.maximal_paths(kept, paths.with_cuts(linked, genome, ["locus"], K), ["locus", "est_id"], least=K)


@query
def g03_maximal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths' pairings, as text."""
    return _paths(spark, sf_dir).select("locus", "est_id", "path_no", F.array_join(F.transform("path", lambda x: F.concat_ws("-", x["p"], x["t"], x["l"])), ",").alias("path"))


@query
def p02_path_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths' exons."""
    return _paths(spark, sf_dir).select("est_id", "path_no", F.posexplode(paths.path_exons(F.col("path"), K)).alias("ord", "e")).select("est_id", "path_no", "ord", "e.*")


def _exon(est_start: Column, est_end: Column, gen_start: Column, gen_end: Column) -> Column:
    return F.struct(*(v.cast("bigint").alias(c) for c, v in (("est_start", est_start), ("est_end", est_end), ("gen_start", gen_start), ("gen_end", gen_end))))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, k (what is planted goes by it), a, b and c (three thirds), d and e (the
    introns), est and genome; short pieces have only a."""
    n = F.length("seq")
    at = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / (PIECE + 2 * INNER)))
    rows = sequences(spark, sf_dir).filter(n > 0).select("doc_id", F.posexplode(F.transform(at, lambda i: F.substring("seq", (i * (PIECE + 2 * INNER) + 1).cast("int"), F.lit(PIECE + 2 * INNER)))).alias("piece", "text"))
    third = F.floor((F.length("text") - 2 * INNER) / 3).cast("int")
    rows = rows.withColumn("w", F.when(third >= THIRD, third)).withColumn("k", (F.col("doc_id") + F.col("piece")).cast("int"))
    cut = lambda start, size: F.substring("text", start, size)
    w, inner = F.col("w"), F.lit(INNER)
    inside = lambda start, donor: F.concat(F.lit(donor), cut(start, inner), F.lit("AG"))
    parts = rows.select("doc_id", "piece", "k", "w", F.coalesce(cut(F.lit(1), w), "text").alias("a"), cut(w + 1, w).alias("b"), F.expr("substring(text, 2 * w + 1, w)").alias("c"), inside(3 * w + 1, "GT").alias("d"), inside(3 * w + INNER + 1, "GC").alias("e"))
    return parts.withColumn("est", F.concat("a", F.coalesce("b", F.lit("")), F.coalesce("c", F.lit("")))).withColumn("genome", F.concat("a", F.coalesce(F.concat("d", "b", "e", "c"), F.lit(""))))


def _aligned(rows: DataFrame, shift: Column) -> DataFrame:
    """The three exons of a piece, with both junctions ``shift`` bases from their places."""
    w, gap = F.col("w"), INNER + 4
    three = F.array(_exon(F.lit(1), w + shift, F.lit(1), w + shift), _exon(w + shift + 1, 2 * w + shift, w + gap + shift + 1, 2 * w + gap + shift), _exon(2 * w + shift + 1, 3 * w, 2 * w + 2 * gap + shift + 1, 3 * w + 2 * gap))
    return _derived(rows, F.when(w.isNotNull(), three).otherwise(_whole()))


def _whole() -> Column:
    return F.array(_exon(F.lit(1), F.length("a"), F.lit(1), F.length("a")))


def _derived(rows: DataFrame, exons: Column) -> DataFrame:
    """What a query is about, written: its expressions would be repeated for every use of
    an exon's borders otherwise."""
    return cut_lineage(rows.select(*_IDS, "est", "genome", exons.alias("exons")))


_IDS = ["doc_id", "piece"]


def _told(rows: DataFrame) -> DataFrame:
    return rows.select(*_IDS, F.posexplode("exons").alias("ord", "e")).select(*_IDS, "ord", "e.*")


@query
def p12_splice_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions up to four bases off: GT-AG ones, then GC-AG ones."""
    return _told(splices.refine(_aligned(_pieces(spark, sf_dir), F.col("k") % 9 - 4)))


@query
def p05_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a substituted base near each end."""
    rows = _pieces(spark, sf_dir)
    n = F.length("est")
    at = lambda i: F.translate(F.substring("est", i, F.lit(1)), "ACGT", "CGTA")
    first, last = 1 + F.col("k") % 5, n - F.col("k") % 7
    noisy = F.concat(F.substring("est", F.lit(1), first - 1), at(first), F.substring("est", first + 1, F.greatest(last - first - 1, F.lit(0))), at(last))
    odd = rows.withColumn("est", F.when(n >= 40, F.concat(noisy, F.substring("est", last + 1, n))).otherwise(F.col("est")))
    return _told(paths.trimmed(_aligned(odd, F.lit(0))))


@query
def p11_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments that miss up to eight bases of the read at the first junction."""
    missed = (F.col("doc_id") + F.col("piece")) % 9
    less = F.transform("exons", lambda e, i: F.struct((e["est_start"] + F.when(i == 1, missed).otherwise(0)).alias("est_start"), e["est_end"], (e["gen_start"] + F.when(i == 1, missed).otherwise(0)).alias("gen_start"), e["gen_end"]))
    return _told(paths.filled(_derived(_aligned(_pieces(spark, sf_dir), F.lit(0)), less), _IDS))


@query
def p16_false_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten last bases of the first exon lie in the first intron as well, and are
    aligned there."""
    n = 6 + F.col("k") % 5
    rows = _pieces(spark, sf_dir).withColumn("n", n)
    # the copy stands in the middle of the first intron
    half = INNER // 2
    d = F.concat(F.substring("d", F.lit(1), F.lit(half)), F.expr("right(a, n)"), F.expr(f"substring(d, {half} + 1)"))
    rows = rows.withColumn("d", d).withColumn("genome", F.concat("a", F.coalesce(F.concat("d", "b", "e", "c"), F.lit(""))))
    w, at, gap = F.col("w"), F.col("w") + half + 1, INNER + 4
    first, second = w + gap + n, 2 * w + 2 * gap + n
    four = F.array(_exon(F.lit(1), w - n, F.lit(1), w - n), _exon(w - n + 1, w, at, at + n - 1), _exon(w + 1, 2 * w, first + 1, first + w), _exon(2 * w + 1, 3 * w, second + 1, second + w))
    return _told(small_exons.without_false(_derived(rows, F.when(w.isNotNull(), four).otherwise(_whole())), _IDS))


@query
def p17_small_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small exon of 7 to 12 bases in the first intron, aligned behind the first exon."""
    rows = _pieces(spark, sf_dir).withColumn("n", 7 + F.col("k") % 6)
    # the second third begins with the small exon, which another intron follows
    w, n, gap = F.col("w"), F.col("n"), INNER + 4
    rows = rows.withColumn("genome", F.coalesce(F.concat("a", "d", F.expr("left(b, n)"), F.lit("GT"), F.reverse(F.expr(f"substring(d, 3, {INNER})")), F.lit("AG"), F.expr("substring(b, n + 1)"), "e", "c"), "a"))
    second, third = w + 2 * gap, 2 * w + 3 * gap
    three = F.array(_exon(F.lit(1), w + n, F.lit(1), w + n), _exon(w + n + 1, 2 * w, second + n + 1, second + w), _exon(2 * w + 1, 3 * w, third + 1, third + w))
    return _told(small_exons.with_hidden(_derived(rows, F.when(w.isNotNull(), three).otherwise(_whole())), _IDS))
