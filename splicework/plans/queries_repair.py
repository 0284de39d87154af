"""Queries of repair and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import isoforms, repair
from .queries_sequence import _NEXT, _neighbours
from .tables import CHAIN, SEQ, chain, sequences, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p.page_id, d.doc_id FROM pages p JOIN (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source) d ON d.source = 'src' || (p.page_id % 50)")
def j03_id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = repair.first_by_id(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src"), F.col("page_id") % 50).alias("source")).join(first, "source").select("page_id", "doc_id")


#: What a substituted base becomes.
_OTHER = ("ACGT", "CGTA")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each sequence an intron from three to six tenths of its length, a read of its
    exons with a base substituted near each border, and where an agreement would move the
    intron; nulls where the sequence is too short for that."""
    k, n = F.col("doc_id"), F.length("seq")
    rows = sequences(spark, sf_dir).withColumn("n", F.when(n >= 60, n)).withColumn("s", F.floor(F.col("n") * 3 / 10).cast("int") + 1).withColumn("e", F.floor(F.col("n") * 6 / 10).cast("int"))
    other = lambda at: F.translate(F.substring("seq", at, F.lit(1)), *_OTHER)
    est = F.concat(F.expr("left(seq, s - 3)"), other(F.col("s") - 2), F.expr("substring(seq, s - 1, 1)"), F.expr("substring(seq, e + 1, 1)"), other(F.col("e") + 2), F.expr("substring(seq, e + 3)"))
    exon = lambda a, b, c, d: F.struct(*(x.cast("bigint").alias(y) for x, y in ((a, "est_start"), (b, "est_end"), (c, "gen_start"), (d, "gen_end"))))
    one, s, e = F.lit(1), F.col("s"), F.col("e")
    return rows.select(
        "doc_id", F.col("seq").alias("genome"), F.coalesce(est, F.lit("")).alias("est"), (1 + k % 2).cast("int").alias("agree_type"), "s", "e",
        (s + (k % 7).cast("int") - 3).alias("t_start"), (e + (k % 5).cast("int") - 2).alias("t_end"),
        exon(one, s - 1, one, s - 1).alias("donor"), exon(s, s + F.col("n") - e - 1, e + 1, F.col("n")).alias("acceptor"),
    )


# With one substituted base at each border, exon ends of equal lengths align base by base
_MOVES_SQL = f"""{SEQ}, n AS (SELECT doc_id, seq AS g, CASE WHEN length(seq) >= 60 THEN length(seq) END AS n, CAST(1 + doc_id % 2 AS INTEGER) AS agree_type FROM seq),
  b AS (SELECT *, n * 3 // 10 + 1 AS s, n * 6 // 10 AS e FROM n),
  m AS (SELECT *, CAST(s + doc_id % 7 - 3 AS INTEGER) AS t_start, CAST(e + doc_id % 5 - 2 AS INTEGER) AS t_end,
    left(g, s - 3) || translate(substr(g, s - 2, 1), '{_OTHER[0]}', '{_OTHER[1]}') || substr(g, s - 1, 1) AS head, substr(g, e + 1, 1) || translate(substr(g, e + 2, 1), '{_OTHER[0]}', '{_OTHER[1]}') || substr(g, e + 3) AS tail FROM b),
  e AS (SELECT *, CAST(levenshtein(right(head, greatest(s - t_start, 0)) || left(tail, greatest(t_end - e, 0)), substr(g, s, greatest(t_start - s, 0)) || substr(g, t_end + 1, greatest(e - t_end, 0))) AS INTEGER) AS error FROM m)"""


@query(f"WITH {_MOVES_SQL} SELECT doc_id, agree_type, coalesce(t_start, -1) AS t_start, coalesce(t_end, -1) AS t_end, coalesce(error, -1) AS error, coalesce(error <= CASE WHEN agree_type = 1 THEN 0 ELSE 4 END, false) AS allowed FROM e")
def j12_agreement_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.with_error(_moves(spark, sf_dir))
    return found.select("doc_id", "agree_type", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("t_start", "t_end", "error")), F.coalesce("allowed", F.lit(False)).alias("allowed"))


@query()
def j13_realigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _moves(spark, sf_dir)
    new = repair.realigned(F.col("est"), F.coalesce(F.col("s") - 1, F.lit(0)), F.col("genome"), F.coalesce("t_start", F.lit(1)), F.coalesce("t_end", F.lit(0)))
    return rows.select("doc_id", F.when(F.col("s").isNotNull(), new).alias("x")).select("doc_id", *(F.coalesce(f"x.{c}", F.lit(-1)).alias(c) for c in ("score", "cut", "intron_start", "intron_end")))


_ANNOTATION_SQL = "annotation AS (SELECT o_orderkey % 9000 AS refseq, CAST(o_custkey % 50 AS INTEGER) AS rel_start, CAST(o_custkey % 50 + 29 AS INTEGER) AS rel_end FROM orders)"


@query(
    f"""WITH {CHAIN}, {_ANNOTATION_SQL}, first AS (SELECT refseq, min((rel_start, rel_end)) AS a FROM annotation GROUP BY refseq)
    SELECT t.tid, refseq, coalesce(a[1], -1) AS rel_start, coalesce(a[2], -1) AS rel_end FROM (SELECT DISTINCT tid, tid + 11 AS refseq FROM chain) t LEFT JOIN first USING (refseq)""".replace("a[1]", "struct_extract(a, 1)").replace("a[2]", "struct_extract(a, 2)")
)
def j17_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    annotation = rows.select((F.col("o_orderkey") % 9000).alias("refseq"), (F.col("o_custkey") % 50).cast("int").alias("rel_start"), (F.col("o_custkey") % 50 + 29).cast("int").alias("rel_end"))
    tids = chain(spark, sf_dir).select("tid").distinct().withColumn("refseq", F.col("tid") + 11)
    return repair.annotated(tids, annotation).select("tid", "refseq", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("rel_start", "rel_end")))


_DUST_SQL = "CASE WHEN length(x) > 2 THEN 10.0 * coalesce(equal, 0) / (length(x) - 2) / length(x) ELSE 0.0 END"


@query(
    f"""WITH {_NEXT}, ends AS (SELECT doc_id, 'a' AS side, repeat(left(a, 1), CAST(doc_id % 400 AS INTEGER)) || a AS x FROM n UNION ALL SELECT doc_id, 'b', b FROM n),
    pairs AS (SELECT doc_id, side, pair, count(*) AS k FROM (SELECT doc_id, side, unnest(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS pair FROM ends) GROUP BY ALL),
    sums AS (SELECT doc_id, side, sum(k * (k - 1) // 2) AS equal FROM pairs GROUP BY ALL)
    SELECT doc_id, bool_or({_DUST_SQL} > 20) AS low FROM ends LEFT JOIN sums USING (doc_id, side) GROUP BY doc_id"""
)
def p07_low_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.concat(F.repeat(F.expr("left(a, 1)"), (F.col("doc_id") % 400).cast("int")), F.col("a"))
    return _neighbours(spark, sf_dir).select("doc_id", repair.low_complexity(run, F.col("b")).alias("low"))


@query(
    f"""WITH {SEQ}, c AS (SELECT doc_id, seq, substr(lower(seq), CAST(1 + length(seq) * (doc_id % 90) // 100 AS INTEGER), CAST(30 + doc_id % 50 AS INTEGER)) AS cds FROM seq),
    placed AS (SELECT *, strpos(seq, upper(cds)) AS k, length(cds) > 0 AND length(cds) % 3 = 0 AS fine FROM c)
    SELECT doc_id, CAST(CASE WHEN fine AND k > 0 THEN k ELSE 0 END AS INTEGER) AS orf_start, CAST(CASE WHEN fine AND k > 0 THEN k + length(cds) - 1 ELSE 0 END AS INTEGER) AS orf_end, CAST(CASE WHEN fine AND k > 0 THEN least(100, length(cds)) ELSE 100 END AS INTEGER) AS least FROM placed"""
)
def t06_annotated_cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    cds: Column = F.substring(F.lower("seq"), (1 + F.floor(F.length("seq") * (k % 90) / 100)).cast("int"), (30 + k % 50).cast("int"))
    return sequences(spark, sf_dir).select("doc_id", repair.annotated_cds(F.col("seq"), cds).alias("c")).select("doc_id", *(F.coalesce(f"c.{x}", F.lit(0)).alias(x) for x in ("orf_start", "orf_end")), "c.least")


@query(
    f"""WITH {SEQ} SELECT doc_id, concat_ws('; ', CASE WHEN substr(seq, 1, 3) <> 'ATG' THEN 'no start codon' END, CASE WHEN right(seq, 3) NOT IN ('TAA', 'TAG', 'TGA') THEN 'no stop codon' END, CASE WHEN length(seq) % 3 <> 0 THEN 'broken frame' END) AS warnings FROM seq"""
)
def t20_codon_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("doc_id", repair.codon_warnings(F.col("seq")).alias("warnings"))


@query(
    f"""WITH {CHAIN}, e AS (SELECT locus, tid, list((gen_start, gen_end) ORDER BY ord) AS x, tid % 7 = 0 AS refseq, tid % 3 + 1 AS support FROM chain GROUP BY locus, tid),
    i AS (SELECT *, list_transform(range(1, len(x)), lambda k: (struct_extract(x[k], 2) + 1, struct_extract(x[k + 1], 1) - 1)) AS introns, struct_extract(x[1], 1) AS s, struct_extract(x[len(x)], 2) AS e FROM e WHERE len(x) > 1),
    own AS (SELECT *, CASE WHEN refseq THEN (s, e) ELSE min(CASE WHEN refseq THEN (s, e) END) OVER (PARTITION BY locus, introns) END AS t FROM i)
    SELECT locus, min(CASE WHEN refseq OR t IS NULL THEN tid END) AS tid, coalesce(struct_extract(any_value(t), 1), min(s)) AS left_end, coalesce(struct_extract(any_value(t), 2), max(e)) AS right_end, CAST(len(introns) AS INTEGER) AS n_introns, CAST(sum(support) AS BIGINT) AS support, bool_or(refseq) AS refseq, count(*) AS members
    FROM own GROUP BY locus, introns, t"""
)
def g07_first_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = isoforms.exon_arrays(chain(spark, sf_dir), ["locus"]).withColumn("refseq", F.col("tid") % 7 == 0).withColumn("support", F.col("tid") % 3 + 1)
    return repair.first_filtering(rows, ["locus"])


@query(
    f"""WITH {CHAIN}, seqs AS (SELECT locus, tid, string_agg(substr('ATGACCTAAGATGCTGATTAGC', CAST(part % 19 + 1 AS INTEGER), 4), '' ORDER BY ord) AS s, count(*) AS n FROM chain GROUP BY locus, tid),
    codons AS (SELECT locus, tid, n, tid % 3 > 0 AS annotated, CASE WHEN tid % 3 > 0 THEN substr(s, CAST(1 + tid % 4 AS INTEGER), 3) END AS first_codon, CASE WHEN tid % 3 > 0 THEN substr(s, CAST(4 * n - tid % 4 - 2 AS INTEGER), 3) END AS last_codon FROM seqs)
    SELECT locus, tid, coalesce(first_codon, '') AS first_codon, coalesce(last_codon, '') AS last_codon,
      concat_ws(',', CASE WHEN annotated AND first_codon <> 'ATG' THEN 'first' END, CASE WHEN annotated AND last_codon NOT IN ('TAA', 'TAG', 'TGA') THEN 'last' END) AS warnings FROM codons WHERE n > 1"""
)
def t20_isoform_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of four bases; regions that leave out up to three bases at both ends."""
    exons = chain(spark, sf_dir).select("locus", "tid", "ord", F.substring(F.lit("ATGACCTAAGATGCTGATTAGC"), (F.col("part") % 19 + 1).cast("int"), F.lit(4)).alias("seq"))
    k = F.col("tid") % 4
    regions = exons.groupBy("locus", "tid").agg(F.count("*").alias("n")).filter("n > 1").select("locus", "tid", (1 + k).alias("cds_start"), (4 * F.col("n") - k).alias("cds_end"), (F.col("tid") % 3 > 0).alias("annotated"))
    found = repair.isoform_codons(exons, regions, ["locus"])
    return found.select("locus", "tid", *(F.coalesce(c, F.lit("")).alias(c) for c in ("first_codon", "last_codon")), "warnings")
