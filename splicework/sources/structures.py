"""Files that hold whole gene structures: compositions, isoforms, introns and the exons of
reference transcripts. Each becomes a table; fields are cut by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PART = r"^([^:]*):([^:]*):([^:]*)"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")


def _int(x: Column) -> Column:
    return x.try_cast("int")


def read_compositions(spark: SparkSession, path: str) -> DataFrame:
    """Exon chains of a locus with their support (S06): file, strand, comp (from 0),
    support, refseq (null: none), and exons, an array of (left, right, polya, seq). A file
    is one locus: bounds, strand, boundary, counts and last base; the exons; then for each
    composition its support, the numbers of its exons, and a sequence for each."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), _lines(F.col("value")).alias("l"))
    n_exons = F.element_at("l", 6).cast("int")
    exon = lambda x: F.struct(_int(F.regexp_extract(x, _PART, 1)).alias("left"), _int(F.regexp_extract(x, _PART, 2)).alias("right"), (F.regexp_extract(x, _PART, 3) == "1").alias("polya"))
    cut = rows.filter(F.size("l") > 7).select("file", F.element_at("l", 3).cast("int").alias("strand"), F.transform(F.slice("l", F.lit(8), n_exons), exon).alias("all"), F.slice("l", 8 + n_exons, F.size("l")).alias("rest"))
    records = F.split(F.concat(F.lit("\n"), F.array_join(F.filter("rest", lambda x: ~x.isin("#", "*")), "\n")), r"\n(?=\.\d)")
    one = cut.select("file", "strand", "all", F.posexplode(F.filter(records, lambda x: x != "")).alias("comp", "r")).withColumn("r", F.split("r", "\n"))
    head = F.split(F.element_at("r", 1), r"\.")
    numbers = F.split(F.element_at("r", 2), r"\.")
    exons = F.transform(numbers, lambda k, i: F.struct(F.get("all", k.cast("int"))["left"].alias("left"), F.get("all", k.cast("int"))["right"].alias("right"), F.get("all", k.cast("int"))["polya"].alias("polya"), F.get("r", i + 2).alias("seq")))
    return one.select("file", "strand", "comp", F.get(head, F.lit(1)).cast("int").alias("support"), F.nullif(F.array_join(F.slice(head, F.lit(3), F.size(head)), "."), F.lit("")).alias("refseq"), exons.alias("exons"))


def read_isoforms(spark: SparkSession, path: str) -> DataFrame:
    """Isoforms and their exons (S07): isoform, n_exons, and as strings what else the
    header has (refseq, or the flags of an annotated file), with exons (abs_left,
    abs_right, rel_left, rel_right, polya, utr5, utr3, seq); the last two counts are null in
    files before annotation. The leading counts are skipped."""
    rows = spark.read.option("lineSep", ">").text(path).withColumn("l", _lines(F.col("value")))
    head = F.split(F.element_at("l", 1), ":")
    body = F.slice("l", F.lit(2), F.size("l"))
    fields = F.split(F.get(body, F.lit(0)), ":")  # a file's records all have one form
    named = rows.filter(F.size(head) > 1).filter(F.get(head, F.lit(0)).rlike(r"^\d+$")).withColumn("b", body).filter(F.size(fields) >= 5)
    pairs = F.sequence(F.lit(0), F.greatest(F.floor(F.size("b") / 2) - 1, F.lit(0)))

    def exon(i: Column) -> Column:
        f = F.split(F.get("b", (2 * i).cast("int")), ":")
        at = lambda k: F.get(f, F.lit(k)).try_cast("int")
        names = ("abs_left", "abs_right", "rel_left", "rel_right", "polya", "utr5", "utr3")
        return F.struct(*(at(k).alias(n) for k, n in enumerate(names)), F.get("b", (2 * i + 1).cast("int")).alias("seq"))

    return named.select(F.get(head, F.lit(0)).cast("int").alias("isoform"), F.get(head, F.lit(1)).cast("int").alias("n_exons"), F.slice(head, F.lit(3), F.size(head)).alias("flags"), F.transform(pairs, exon).alias("exons"))


#: Fixed order: the columns of an intron file.
INTRON_COLUMNS = (
    "rel_start int, rel_end int, abs_start bigint, abs_end bigint, length int, support int, supporting string, donor_error double, acceptor_error double, "
    "score5 double, score3 double, bps_score double, bps_position int, type string, pattern string, repeat string, donor_suffix string, intron_prefix string, intron_suffix string, acceptor_prefix string"
)


def read_introns(spark: SparkSession, path: str) -> DataFrame:
    """The introns of a file of 20 tab-separated columns (S07); ``supporting`` is an
    array, a repeat of '.' is null."""
    rows = spark.read.schema(INTRON_COLUMNS).option("sep", "\t").csv(path)
    ids = F.filter(F.split("supporting", ","), lambda x: F.trim(x) != "")
    return rows.withColumn("supporting", ids).withColumn("repeat", F.nullif("repeat", F.lit(".")))


def read_reference_exons(spark: SparkSession, path: str) -> DataFrame:
    """left, right and seq of the exons of reference transcripts."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(f) >= 3)
    return rows.select(F.get(f, F.lit(0)).cast("int").alias("left"), F.get(f, F.lit(1)).cast("int").alias("right"), F.get(f, F.lit(2)).alias("seq"))


def cds_tables(isoforms: DataFrame, orfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of annotated isoforms (K07): one row per isoform with its exons and
    reading frame, and one per exon with its untranslated bases at both ends. ``isoforms``
    has tid and exons (gen_start, gen_end), ``orfs`` tid, orf_start and orf_end on the
    transcript."""
    rows = isoforms.join(orfs, "tid", "left")
    length = lambda e: e["gen_end"] - e["gen_start"] + 1
    total = F.aggregate("exons", F.lit(0).cast("bigint"), lambda n, e: n + length(e))
    of_isoforms = rows.select("tid", F.size("exons").alias("n_exons"), total.alias("length"), "orf_start", "orf_end", F.floor((F.col("orf_end") - F.col("orf_start") + 1) / 3 - 1).cast("int").alias("protein_length"))
    each = rows.select("tid", "exons", "orf_start", "orf_end", F.posexplode("exons").alias("i", "e"))
    hi = F.aggregate(F.slice("exons", F.lit(1), F.col("i") + 1), F.lit(0).cast("bigint"), lambda n, e: n + length(e))
    each = each.withColumn("hi", hi).withColumn("lo", F.col("hi") - length(F.col("e")) + 1)
    within = lambda n: F.greatest(F.lit(0), F.least(n, F.col("hi") - F.col("lo") + 1))
    of_exons = each.select("tid", (F.col("i") + 1).alias("ord"), F.col("e.gen_start").alias("gen_start"), F.col("e.gen_end").alias("gen_end"), within(F.col("orf_start") - F.col("lo")).alias("utr5"), within(F.col("hi") - F.col("orf_end")).alias("utr3"))
    return of_isoforms, of_exons
