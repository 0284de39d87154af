"""Queries on isoforms, coding regions, splicing events and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cds, chains, consensus, isoforms, refine
from ..sources import report
from .tables import CHAIN, INTRONS, SEQ, chain, sequences

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# An ORF for two of three transcripts: a fifth from the start to a quarter from the end.
_ORF_SQL = f"""{CHAIN}, orf AS (SELECT tid, 1 + total // 5 AS orf_start, 1 + total // 5 + 3 * ((total - total // 4 - total // 5) // 3) - 1 AS orf_end
  FROM (SELECT tid, CAST(sum(gen_end - gen_start + 1) AS BIGINT) AS total FROM chain GROUP BY tid) WHERE tid % 3 <> 0 AND total >= 60),
  along AS (SELECT *, CAST(sum(gen_end - gen_start + 1) OVER (PARTITION BY tid ORDER BY ord) AS BIGINT) AS hi FROM chain),
  placed AS (SELECT along.*, hi - (gen_end - gen_start) AS lo, CAST(max(hi) OVER (PARTITION BY tid) AS BIGINT) AS total, max(ord) OVER (PARTITION BY tid) AS last_ord FROM along)"""


def _orf(exons: DataFrame) -> DataFrame:
    total = exons.groupBy("tid").agg(F.sum(F.col("gen_end") - F.col("gen_start") + 1).alias("total")).filter("tid % 3 != 0 AND total >= 60")
    start = F.expr("1 + total DIV 5")
    return total.select("tid", start.alias("orf_start"), (start + 3 * F.expr("(total - total DIV 4 - total DIV 5) DIV 3") - 1).alias("orf_end"))


@query(f"WITH {_ORF_SQL} SELECT tid, coalesce(orf_start - 1, -1) AS utr5, coalesce(total - orf_end, -1) AS utr3 FROM (SELECT DISTINCT tid, total FROM placed) LEFT JOIN orf USING (tid)")
def t18_utr_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = chain(spark, sf_dir)
    return cds.utr_lengths(exons, _orf(exons))


@query(
    f"""WITH {_ORF_SQL} SELECT tid, CAST(CASE WHEN max(orf_end) IS NULL THEN -1 WHEN bool_or(lo <= orf_end AND orf_end <= hi AND ord < last_ord AND hi - orf_end > 10) THEN 1 ELSE 0 END AS INTEGER) AS nmd
    FROM placed LEFT JOIN orf USING (tid) GROUP BY tid"""
)
def t17_nmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = chain(spark, sf_dir)
    return cds.nmd(exons, _orf(exons), most=10)


def _place_sql(first: str, last: str) -> str:
    return f"""WITH {_ORF_SQL}, p AS (SELECT *, {first} AS a, {last} AS b FROM placed JOIN orf USING (tid))
    SELECT tid, max(CASE WHEN lo <= a AND a <= hi THEN ord END) AS left_ord, max(CASE WHEN lo <= b AND b <= hi THEN ord END) AS right_ord,
      max(CASE WHEN lo <= a AND a <= hi THEN gen_start + a - lo END) AS gen_left, max(CASE WHEN lo <= b AND b <= hi THEN gen_start + b - lo END) AS gen_right FROM p GROUP BY tid"""


@query(_place_sql("orf_start", "orf_end"))
def t08_orf_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = chain(spark, sf_dir)
    return cds.place(exons, _orf(exons))


@query(_place_sql("total - orf_end + 1", "total - orf_start + 1"))
def t08_orf_place_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = chain(spark, sf_dir)
    return cds.place(exons, _orf(exons), strand=-1)


def _region_sql(minus: bool) -> str:
    lo, hi = ("total - hi + 1", "total - lo + 1") if minus else ("lo", "hi")
    left, right = ("gen_end - (b - l)", "gen_end - (a - l)") if minus else ("gen_start + a - l", "gen_start + b - l")
    named = [("5UTR", "1", "orf_start - 1"), ("start_codon", "orf_start", "orf_start + 2"), ("CDS", "orf_start", "orf_end - 3"), ("stop_codon", "orf_end - 2", "orf_end"), ("3UTR", "orf_end + 1", "total")]
    parts = " UNION ALL ".join(f"SELECT tid, ord, gen_start, gen_end, l, '{k}' AS feature, greatest({a}, l) AS a, least({b}, h) AS b FROM p" for k, a, b in named)
    return f"WITH {_ORF_SQL}, p AS (SELECT *, {lo} AS l, {hi} AS h FROM placed JOIN orf USING (tid)), f AS ({parts}) SELECT tid, ord, feature, {left} AS start, {right} AS \"end\" FROM f WHERE a <= b"


@query(_region_sql(False))
def t19_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = chain(spark, sf_dir)
    return cds.regions(exons, _orf(exons))


@query(_region_sql(True))
def t19_regions_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = chain(spark, sf_dir)
    return cds.regions(exons, _orf(exons), strand=-1)


@query(
    f"""WITH {CHAIN} SELECT tid, ord, CASE WHEN a = b THEN CASE a WHEN 0 THEN '5UTR' WHEN 1 THEN 'CDS' ELSE '3UTR' END WHEN a = 0 AND b = 1 THEN '5UTR_CDS' WHEN a = 1 AND b = 2 THEN 'CDS_3UTR' ELSE '5UTR_3UTR' END AS location
    FROM (SELECT tid, ord, CASE WHEN gen_start < 150 THEN 0 WHEN gen_start <= 400 THEN 1 ELSE 2 END AS a, CASE WHEN gen_end < 150 THEN 0 WHEN gen_end <= 400 THEN 1 ELSE 2 END AS b FROM chain)"""
)
def t11_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).select("tid", "ord", cds.location(F.col("gen_start"), F.col("gen_end"), F.lit(150), F.lit(400)).alias("location"))


# Isoforms: all of each locus; the reference is the one with the least tid.
_ISO_SQL = f"{CHAIN}, iso AS (SELECT * FROM chain), refs AS (SELECT * FROM iso WHERE (locus, tid) IN (SELECT (locus, min(tid)) FROM iso GROUP BY locus))"
_EXON_SQL = f"{_ISO_SQL}, a AS (SELECT *, max(ord) OVER (PARTITION BY tid) AS n FROM iso), b AS (SELECT *, max(ord) OVER (PARTITION BY tid) AS n FROM refs)"
_GAPS_SQL = """, ri AS (SELECT * FROM (SELECT locus, tid, gen_end + 1 AS i_start, lead(gen_start) OVER (PARTITION BY tid ORDER BY ord) - 1 AS i_end FROM refs) WHERE i_end IS NOT NULL),
  oi AS (SELECT * FROM (SELECT locus, tid, gen_end + 1 AS i_start, lead(gen_start) OVER (PARTITION BY tid ORDER BY ord) - 1 AS i_end FROM iso) WHERE i_end IS NOT NULL)"""


def _isoforms(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    iso = chain(spark, sf_dir) if rows is None else rows
    first = iso.groupBy("locus").agg(F.min("tid").alias("tid"))
    return iso, iso.join(first, ["locus", "tid"], "left_semi")


@query(
    f"""WITH {_EXON_SQL} SELECT a.locus, a.tid, a.ord, b.ord AS ord_r, 'A5E' AS event, a.gen_end - b.gen_end AS shift FROM a JOIN b USING (locus) WHERE a.gen_start = b.gen_start AND a.gen_end <> b.gen_end AND a.ord < a.n AND b.ord < b.n AND a.tid <> b.tid
    UNION ALL SELECT a.locus, a.tid, a.ord, b.ord, 'A3E', b.gen_start - a.gen_start FROM a JOIN b USING (locus) WHERE a.gen_end = b.gen_end AND a.gen_start <> b.gen_start AND a.ord > 1 AND b.ord > 1 AND a.tid <> b.tid"""
)
def t14_competing_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cds.competing_sites(*_isoforms(spark, sf_dir), ["locus"])


# Transcripts of even number keep every second intron, as part of an exon.
_JOINED = "chain AS (SELECT locus, tid, CAST(CASE WHEN tid % 2 = 0 THEN (ord + 1) // 2 ELSE ord END AS INTEGER) AS ord, min(gen_start) AS gen_start, max(gen_end) AS gen_end FROM whole_chain GROUP BY ALL)"
_KEPT_SQL = _ISO_SQL.replace("chain AS (", "whole_chain AS (", 1).replace("FROM starts)", f"FROM starts), {_JOINED}", 1)


@query(
    f"""WITH {_KEPT_SQL}{_GAPS_SQL} SELECT DISTINCT c.locus, c.tid, 'IR+' AS event, i_start, i_end FROM iso c JOIN ri USING (locus) WHERE c.gen_start < i_start AND i_end < c.gen_end AND c.tid <> ri.tid
    UNION SELECT DISTINCT oi.locus, oi.tid, 'IR-', i_start, i_end FROM oi JOIN refs r USING (locus) WHERE r.gen_start < i_start AND i_end < r.gen_end AND oi.tid <> r.tid"""
)
def t15_intron_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = F.when(F.col("tid") % 2 == 0, F.floor((F.col("ord") + 1) / 2)).otherwise(F.col("ord")).cast("int")
    rows = chain(spark, sf_dir).groupBy("locus", "tid", merged.alias("ord")).agg(F.min("gen_start").alias("gen_start"), F.max("gen_end").alias("gen_end"))
    return cds.retained(*_isoforms(spark, sf_dir, rows), ["locus"])


@query(
    f"""WITH {_ISO_SQL}{_GAPS_SQL} SELECT DISTINCT oi.locus, oi.tid, 'skip' AS event, r.gen_start AS start, r.gen_end AS "end" FROM oi JOIN refs r USING (locus) WHERE i_start <= r.gen_start AND r.gen_end <= i_end AND oi.tid <> r.tid
    UNION SELECT DISTINCT c.locus, c.tid, 'new', c.gen_start, c.gen_end FROM iso c JOIN ri USING (locus) WHERE i_start <= c.gen_start AND c.gen_end <= i_end AND c.tid <> ri.tid"""
)
def t16_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cds.skipped(*_isoforms(spark, sf_dir), ["locus"])


@query(
    f"""WITH {_EXON_SQL}, f AS (SELECT locus, tid, arg_min((gen_start, gen_end), ord) AS f, arg_max((gen_start, gen_end), ord) AS l FROM iso GROUP BY ALL), r AS (SELECT locus, arg_min((gen_start, gen_end), ord) AS fr, arg_max((gen_start, gen_end), ord) AS lr FROM refs GROUP BY ALL)
    SELECT locus, tid, f <> fr AS init, l <> lr AS term FROM f JOIN r USING (locus)"""
)
def t16_outer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cds.outer_changes(*_isoforms(spark, sf_dir), ["locus"])


@query(
    f"""WITH {_ORF_SQL}, o AS (SELECT locus, tid, gen_start + greatest(lo, orf_start) - lo AS a, gen_start + least(hi, orf_end) - lo AS b, (((greatest(lo, orf_start) - orf_start - (gen_start + greatest(lo, orf_start) - lo)) % 3) + 3) % 3 AS phase
      FROM placed JOIN orf USING (tid) WHERE greatest(lo, orf_start) <= least(hi, orf_end)),
    r AS (SELECT * FROM o WHERE (locus, tid) IN (SELECT (locus, min(tid)) FROM chain GROUP BY locus)),
    own AS (SELECT locus, tid, sum(b - a + 1) AS coding FROM o GROUP BY ALL),
    s AS (SELECT o.locus, o.tid, sum(least(o.b, r.b) - greatest(o.a, r.a) + 1) AS shared, bool_and(o.phase = r.phase) AS same FROM o JOIN r ON o.locus = r.locus AND o.a <= r.b AND r.a <= o.b GROUP BY ALL)
    SELECT locus, tid, coalesce(same AND CAST(shared AS BIGINT) * 100 // CAST(coding AS BIGINT) >= 50, false) AS in_frame FROM own LEFT JOIN s USING (locus, tid)"""
)
def t13_inframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso, refs = _isoforms(spark, sf_dir)
    orf = _orf(chain(spark, sf_dir))
    return cds.in_frame(iso, orf, refs, orf, ["locus"])


_KNOWN_SQL = f"{INTRONS}, sup AS (SELECT locus, i_start, i_end, count(*) AS support, i_start % 70 = 0 AS exempt FROM introns GROUP BY ALL)"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.intron_support(chains.introns(chain(spark, sf_dir)), ["locus"]).withColumn("exempt", F.col("i_start") % 70 == 0)


@query(f"WITH {_KNOWN_SQL} SELECT locus, tid, min(support) AS bottleneck FROM introns JOIN sup USING (locus, i_start, i_end) GROUP BY locus, tid HAVING bool_and(support >= 2 OR exempt)")
def g15_support_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isoforms.supported(chain(spark, sf_dir), _known(spark, sf_dir), ["locus"])


@query(
    f"""WITH {_KNOWN_SQL}, b AS (SELECT locus, tid, min(support) AS bottleneck FROM introns JOIN sup USING (locus, i_start, i_end) GROUP BY locus, tid),
    s AS (SELECT locus, tid, count(*) AS n_exons, CAST(sum(gen_end - gen_start + 1) AS BIGINT) AS length FROM chain GROUP BY locus, tid),
    f AS (SELECT *, tid % 3 <> 0 AND length >= 60 AS has_orf, tid % 11 = 0 AS is_refseq, tid % 5 = 0 AS type_one FROM s LEFT JOIN b USING (locus, tid))
    SELECT locus, tid FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY has_orf DESC, is_refseq DESC, CASE WHEN is_refseq THEN n_exons * coalesce(bottleneck, 0) ELSE 0 END DESC, type_one DESC, n_exons DESC, length DESC, tid) AS r FROM f) WHERE r = 1"""
)
def t09_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = chain(spark, sf_dir)
    least = isoforms.supported(exons, _known(spark, sf_dir), ["locus"], least=0).select("locus", "tid", "bottleneck")
    rows = chains.summaries(exons, ["locus"]).withColumnRenamed("covered", "length").join(least, ["locus", "tid"], "left").withColumn("bottleneck", F.coalesce("bottleneck", F.lit(0)))
    flags = rows.withColumn("has_orf", (F.col("tid") % 3 != 0) & (F.col("length") >= 60)).withColumn("is_refseq", F.col("tid") % 11 == 0).withColumn("type_one", F.col("tid") % 5 == 0)
    return cds.reference(flags, ["locus"]).select("locus", "tid")


@query(
    f"""WITH {_KNOWN_SQL}, t AS (SELECT locus, tid, ord, CASE WHEN i_start % 70 = 0 THEN 0 WHEN support > 1 THEN 1 ELSE 2 END AS k FROM introns JOIN sup USING (locus, i_start, i_end))
    SELECT locus, tid, CAST(arg_min(k, ord) AS INTEGER) AS isoform_type FROM t GROUP BY locus, tid"""
)
def t04_isoform_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _known(spark, sf_dir).withColumn("intron_type", cds.intron_type(F.col("exempt"), F.col("support")))
    return cds.isoform_type(chains.introns(chain(spark, sf_dir)), typed, ["locus"])


@query(
    f"""WITH {CHAIN}, m AS (SELECT *, min(ord) OVER (PARTITION BY tid) AS lo, max(ord) OVER (PARTITION BY tid) AS hi FROM chain)
    SELECT locus, gen_start, gen_end, CAST(max(CASE WHEN lo = hi THEN -3 WHEN ord = lo THEN -1 WHEN ord = hi THEN -2 ELSE 1 END) AS INTEGER) AS role, count(*) AS uses FROM m GROUP BY locus, gen_start, gen_end"""
)
def g06_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isoforms.roles(chain(spark, sf_dir), ["locus"])


_RUN_SQL = f"""{INTRONS}, r AS (SELECT locus, tid, ',' || string_agg(i_start || '-' || i_end, ',' ORDER BY ord) || ',' AS s, count(*) AS n FROM introns GROUP BY locus, tid),
  e AS (SELECT locus, tid, list((gen_start, gen_end) ORDER BY ord) AS x FROM chain GROUP BY locus, tid),
  c AS (SELECT r.locus, r.tid, s, n, x, struct_extract(x[1], 1) AS lo, struct_extract(x[n + 1], 2) AS hi FROM r JOIN e USING (locus, tid)),
  p AS (SELECT a.locus, a.tid, b.tid AS tid2, a.lo, a.hi, b.x AS bx, a.n, b.n AS bn, a.x AS ax, len(string_split(split_part(b.s, a.s, 1), ',')) - 1 AS k, a.s AS sa, b.s AS sb FROM c a JOIN c b ON a.locus = b.locus AND a.tid <> b.tid AND contains(b.s, a.s)),
  q AS (SELECT *, CASE WHEN split_part(sb, sa, 1) = '' THEN 0 ELSE k END AS at_ FROM p)"""


@query(
    f"""WITH {_RUN_SQL}, gone AS (SELECT DISTINCT locus, tid FROM q WHERE lo >= struct_extract(bx[at_ + 1], 1) AND hi <= struct_extract(bx[at_ + 1 + n], 2) AND (ax <> bx OR tid2 < tid))
    SELECT locus, tid FROM c WHERE (locus, tid) NOT IN (SELECT (locus, tid) FROM gone)"""
)
def g14_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isoforms.without_contained(chain(spark, sf_dir), ["locus"])


# Transcripts of odd number lack their first exon, so that chains start inside others.
_SHORT = "chain AS (SELECT locus, tid, CAST(ord - tid % 2 AS INTEGER) AS ord, gen_start, gen_end, part FROM whole_chain WHERE ord > tid % 2)"
_PAIRS_SQL = f"""{INTRONS.replace("chain AS (", "whole_chain AS (", 1).replace("FROM starts)", f"FROM starts), {_SHORT}", 1)}, l AS (SELECT locus, tid, list((i_start, i_end) ORDER BY ord) AS i FROM introns GROUP BY locus, tid), e AS (SELECT locus, tid, list((gen_start, gen_end) ORDER BY ord) AS x FROM chain GROUP BY locus, tid),
  j AS (SELECT l.*, x FROM l JOIN e USING (locus, tid)), b AS (SELECT *, unnest(range(len(i))) AS k FROM j),
  p AS (SELECT a.locus, a.tid AS tid1, b.tid AS tid2, k, len(a.i) AS n1, len(b.i) AS n2, a.x AS x1, b.x AS x2, struct_extract(a.x[1], 1) >= struct_extract(b.x[k + 1], 1) AS first_in
    FROM j a JOIN b ON a.locus = b.locus AND a.tid <> b.tid AND a.i[1] = b.i[k + 1] WHERE a.i[1:least(len(a.i), len(b.i) - k)] = b.i[k + 1:k + least(len(a.i), len(b.i) - k)]),
  r AS (SELECT *, CASE WHEN n2 - k >= n1 AND (first_in OR k = 0) AND (k + n1 = n2 OR struct_extract(x1[n1 + 1], 2) <= struct_extract(x2[k + n1 + 1], 2)) THEN 'included' WHEN n2 - k < n1 AND first_in AND k > 0 THEN 'extends' END AS relation FROM p)"""


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = (F.col("tid") % 2).cast("int")
    return chain(spark, sf_dir).filter(F.col("ord") > lost).withColumn("ord", F.col("ord") - lost)


@query(f"WITH {_PAIRS_SQL} SELECT locus, tid1, tid2, CAST(k AS INTEGER) AS at, relation FROM r WHERE relation IS NOT NULL")
def g08_chain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isoforms.chain_pairs(_short(spark, sf_dir), ["locus"])


@query(
    f"""WITH {_PAIRS_SQL} SELECT locus, tid1, tid2, array_to_string(list_transform(list_concat(x2[1:k], [(struct_extract(x2[k + 1], 1), struct_extract(x1[1], 2))], x1[2:]), lambda y: struct_extract(y, 1) || '-' || struct_extract(y, 2)), ',') AS exons FROM r WHERE relation = 'extends'"""
)
def g12_merged_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = isoforms.merged_pairs(_short(spark, sf_dir), ["locus"])
    return merged.withColumn("exons", F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["s"], e["e"])), ","))


_SITE_SQL = f"{SEQ}, rows AS (SELECT doc_id, seq, 21 AS i_start, 60 + CAST(doc_id % 40 AS INTEGER) AS i_end FROM seq WHERE length(seq) >= 200)"


def _frequency_sql(k: str) -> str:
    from ..functions.sequence import FREQUENCIES

    return f"coalesce(map_extract_value(MAP {{{', '.join(f"'{p}': {n}" for p, n in FREQUENCIES.items())}}}, {k}), 0)"


def _moved_sql(tried: str, moved: str) -> str:
    return f"""WITH {_SITE_SQL}, tried AS ({tried}), f AS (SELECT *, {_frequency_sql("substr(seq, i_start, 2) || substr(seq, i_end - 1, 2)")} AS old_frequency, {_frequency_sql("substr(seq, new_start, 2) || substr(seq, new_end - 1, 2)")} AS new_frequency
      FROM tried WHERE new_start >= 1 AND new_end <= length(seq) AND new_start < new_end)
      SELECT doc_id, CAST(new_start AS INTEGER) AS new_start, CAST(new_end AS INTEGER) AS new_end, CAST(old_frequency AS INTEGER) AS old_frequency, CAST(new_frequency AS INTEGER) AS new_frequency FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY new_frequency DESC, {moved}, new_start, new_end) AS r FROM f WHERE new_frequency > old_frequency) WHERE r = 1"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).filter(F.length("seq") >= 200).select("doc_id", F.col("seq").alias("genome"), F.lit(21).alias("i_start"), (60 + F.col("doc_id") % 40).cast("int").alias("i_end"))


@query(_moved_sql("SELECT *, i_start AS new_start, i_end + d AS new_end FROM (SELECT *, unnest(range(-15, 16)) AS d FROM rows)", "abs(d)"))
def j09_single_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.single_site(_sites(spark, sf_dir), ["doc_id"])


@query(_moved_sql("SELECT *, i_start + a AS new_start, i_end + b AS new_end FROM (SELECT *, unnest(range(-3, 4)) AS b FROM (SELECT *, unnest(range(-3, 4)) AS a FROM rows))", "abs(a) + abs(b)"))
def j11_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.nearby(_sites(spark, sf_dir), ["doc_id"])


@query(
    f"""WITH {CHAIN} SELECT tid, 'chr' || locus || chr(9) || 'splicework' || chr(9) || 'exon' || chr(9) || least(gen_start, gen_end) || chr(9) || greatest(gen_start, gen_end) || chr(9) || '.' || chr(9) || CASE WHEN tid % 2 = 0 THEN '+' ELSE '-' END || chr(9) || '.' || chr(9)
    || 'gene_id "' || locus || '"; transcript_id "' || locus || '.' || tid || '";' AS line FROM chain"""
)
def k09_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir).select("tid", F.concat(F.lit("chr"), F.col("locus")).alias("chrom"), F.lit("exon").alias("feature"), F.col("gen_start").alias("start"), F.col("gen_end").alias("end"), F.when(F.col("tid") % 2 == 0, 1).otherwise(-1).alias("strand"), F.lit(None).cast("int").alias("frame"), F.col("locus").alias("gene"), F.col("tid").alias("isoform"))
    return report.gtf_lines(rows, keep=["tid"])


@query(
    f"""WITH {INTRONS}, s AS (SELECT locus, i_start, i_end, count(*) AS support FROM introns GROUP BY ALL)
    SELECT locus, count(*) AS n_introns, sha256(string_agg(i_start || ':' || i_end || ':' || support, ',' ORDER BY i_start, i_end)) AS digest FROM s GROUP BY locus"""
)
def k08_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The introns of each locus as one JSON document, read back from it."""
    support = chains.intron_support(chains.introns(chain(spark, sf_dir)), ["locus"])
    documents = report.intron_json(support, ["locus"])
    back = documents.withColumn("x", F.from_json("document", "introns array<struct<relative_start:bigint,relative_end:bigint,number_of_supporting_transcripts:bigint>>")["introns"])
    text = F.array_join(F.transform("x", lambda i: F.concat_ws(":", i["relative_start"], i["relative_end"], i["number_of_supporting_transcripts"])), ",")
    return back.select("locus", F.size("x").cast("bigint").alias("n_introns"), F.sha2(text.cast("binary"), 256).alias("digest"))


@query(
    f"""WITH {INTRONS}, s AS (SELECT locus, i_start, i_end, count(*) AS support, string_agg(CAST(tid AS VARCHAR), ',' ORDER BY tid) AS supporting FROM introns GROUP BY locus, i_start, i_end)
    SELECT locus, i_start, i_end, i_start + 999 AS abs_start, i_end + 999 AS abs_end, i_end - i_start + 1 AS length, support, supporting FROM s"""
)
def k03_intron_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.intron_table(chains.introns(chain(spark, sf_dir)), ["locus"], F.lit(1), F.lit(1000), F.lit(10**6))


@query(f"WITH {CHAIN}, n AS (SELECT locus, tid, count(*) AS n FROM chain GROUP BY ALL) SELECT CAST(unnest(range(1, least(n, 4) + 1)) AS INTEGER) AS least_exons, locus, tid FROM n")
def k06_isoform_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chains.summaries(chain(spark, sf_dir), ["locus"])
    return report.by_least_exons(rows).select("least_exons", "locus", "tid")


@query(
    f"""WITH {_ORF_SQL}, p AS (SELECT locus, tid, max(CASE WHEN lo <= orf_start AND orf_start <= hi THEN gen_start + orf_start - lo END) AS l, max(CASE WHEN lo <= orf_end AND orf_end <= hi THEN gen_start + orf_end - lo END) AS r FROM placed JOIN orf USING (tid) GROUP BY locus, tid),
    ref AS (SELECT locus, l AS rl, r AS rr FROM p WHERE (locus, tid) IN (SELECT (locus, min(tid)) FROM p GROUP BY locus))
    SELECT locus, tid, CASE WHEN locus % 2 = 0 THEN l = rl ELSE r = rr END AS same_start, CASE WHEN locus % 2 = 0 THEN r = rr ELSE l = rl END AS same_stop FROM p JOIN ref USING (locus)"""
)
def t10_codons_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = chain(spark, sf_dir)
    placed = cds.place(exons, _orf(exons)).join(exons.select("locus", "tid").distinct(), "tid").withColumn("strand", F.when(F.col("locus") % 2 == 0, 1).otherwise(-1))
    first = placed.groupBy("locus").agg(F.min("tid").alias("tid"))
    return refine.codons_agree(placed, placed.join(first, ["locus", "tid"], "left_semi"), ["locus"])
