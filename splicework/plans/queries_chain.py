"""Queries on exon chains and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import chains, consensus, cover, graphs, intervals, matching, refine
from .tables import CHAIN, INTRONS, SPANS, chain, spans, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH {SPANS}, m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
    i AS (SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS members FROM i GROUP BY user_id, island"""
)
def w01_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(spans(spark, sf_dir), ["user_id"])


_WINDOWS_SQL = f"""{CHAIN}, coarse AS (SELECT DISTINCT tid % 2000 AS grp, gen_start AS start, gen_end AS "end" FROM chain),
    m AS (SELECT *, max("end") OVER (PARTITION BY grp ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM coarse),
    i AS (SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
    win AS (SELECT grp, min(start) AS w_start, max("end") AS w_end FROM i GROUP BY grp, island)"""


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).select((F.col("tid") % 2000).alias("grp"), "tid", "ord", F.col("gen_start").alias("start"), F.col("gen_end").alias("end"))


@query(f"""WITH {_WINDOWS_SQL} SELECT c.tid, c.ord, c.tid % 2000 AS grp, w_start, w_end FROM chain c JOIN win ON grp = c.tid % 2000 AND w_start <= gen_start AND gen_end <= w_end""")
def j04_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = _factors(spark, sf_dir)
    windows = intervals.union(factors.select("grp", "start", "end").distinct(), ["grp"]).select("grp", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.containing_window(factors, windows, ["grp"]).select("tid", "ord", "grp", F.col("r_start").alias("w_start"), F.col("r_end").alias("w_end"))


@query(
    f"""WITH RECURSIVE {CHAIN}, ints AS (SELECT tid % 200 AS grp, tid * 100 + ord AS id, gen_start AS s, gen_end AS e FROM chain),
    up AS (SELECT a.grp, a.id, min(b.id) AS up FROM ints a JOIN ints b ON a.grp = b.grp AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e OR b.id < a.id) GROUP BY a.grp, a.id),
    walk(grp, id, node) AS (SELECT grp, id, id FROM ints UNION ALL SELECT w.grp, w.id, u.up FROM walk w JOIN up u ON w.grp = u.grp AND w.node = u.id)
    SELECT w.grp, w.id, w.node AS root FROM walk w LEFT JOIN up u ON w.grp = u.grp AND w.node = u.id WHERE u.up IS NULL"""
)
def j18_cover_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir).select((F.col("tid") % 200).alias("grp"), (F.col("tid") * 100 + F.col("ord")).alias("id"), F.col("gen_start").alias("start"), F.col("gen_end").alias("end"))
    return intervals.cover_roots(rows, ["grp"], width=64)


@query(f"WITH {INTRONS} SELECT tid, ord, i_start, i_end FROM introns")
def w03_chain_to_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.introns(chain(spark, sf_dir)).select("tid", "ord", "i_start", "i_end")


@query(f"WITH {INTRONS} SELECT locus, i_start, i_end, count(*) AS support FROM introns GROUP BY ALL")
def j05_intron_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.intron_support(chains.introns(chain(spark, sf_dir)), ["locus"])


@query(f"WITH {INTRONS} SELECT locus, i_start, i_end, string_agg(CAST(tid AS VARCHAR), ',' ORDER BY tid) AS supporting FROM introns GROUP BY locus, i_start, i_end")
def a02_support_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.support_list(chains.introns(chain(spark, sf_dir)), ["locus"])


@query(f"WITH {INTRONS} SELECT locus, i_start, i_end, round(avg(part % 7), 9) AS mean_error FROM introns GROUP BY ALL")
def a03_mean_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.introns(chain(spark, sf_dir)).groupBy("locus", "i_start", "i_end").agg(F.round(F.avg(F.col("part") % 7), 9).alias("mean_error"))


@query(f"WITH {INTRONS} SELECT tid, CAST(coalesce(sum(i_end - i_start + 1), 0) AS BIGINT) AS gap FROM (SELECT DISTINCT tid FROM chain) LEFT JOIN introns USING (tid) GROUP BY tid")
def w04_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.total_gap(chain(spark, sf_dir))


@query(f"WITH {CHAIN} SELECT tid, ord, CAST(sum(gen_end - gen_start + 1) OVER (PARTITION BY tid ORDER BY ord) AS BIGINT) AS cum FROM chain")
def w05_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.cumulative(chain(spark, sf_dir)).select("tid", "ord", "cum")


@query(
    f"""WITH {CHAIN} SELECT tid, ord, CAST((3 - before % 3) % 3 AS INTEGER) AS frame
    FROM (SELECT tid, ord, coalesce(sum(gen_end - gen_start + 1) OVER (PARTITION BY tid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chain)"""
)
def w06_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.frames(chain(spark, sf_dir)).select("tid", "ord", "frame")


_SUMMARY_SQL = f"{CHAIN}, sums AS (SELECT locus, tid, count(*) AS n_exons, min(gen_start) AS left_end, max(gen_end) AS right_end, CAST(sum(gen_end - gen_start + 1) AS BIGINT) AS covered FROM chain GROUP BY locus, tid)"


@query(f"WITH {_SUMMARY_SQL} SELECT * FROM sums")
def a08_chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.summaries(chain(spark, sf_dir), ["locus"])


@query(f"WITH {_SUMMARY_SQL} SELECT locus, tid, CAST(row_number() OVER (PARTITION BY locus ORDER BY tid % 7 = 0 DESC, n_exons DESC, tid) AS INTEGER) AS isoform_no FROM sums")
def w07_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chains.summaries(chain(spark, sf_dir), ["locus"]).withColumn("is_reference", F.col("tid") % 7 == 0)
    return chains.isoform_numbers(rows, ["locus"]).select("locus", "tid", "isoform_no")


@query(f"WITH {CHAIN} SELECT locus, gen_start, gen_end, CAST(row_number() OVER (PARTITION BY locus ORDER BY gen_start, gen_end) AS INTEGER) AS exon_no FROM (SELECT DISTINCT locus, gen_start, gen_end FROM chain)")
def w08_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.exon_numbers(chain(spark, sf_dir), ["locus"])


@query(
    f"""WITH {CHAIN}, r AS (SELECT *, sum(CASE WHEN part % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY ord) AS run FROM chain),
    seg AS (SELECT tid, run, min(ord) AS first_ord, max(ord) AS last_ord, CAST(sum(gen_end - gen_start + 1) AS BIGINT) AS bases FROM r WHERE part % 4 <> 0 GROUP BY tid, run)
    SELECT tid, first_ord, last_ord, bases FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY bases DESC, first_ord) AS k FROM seg) WHERE k = 1"""
)
def w09_best_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.best_segment(chain(spark, sf_dir), F.col("part") % 4 == 0)


@query(f"WITH {CHAIN} SELECT tid, bool_and(gen_start <= gen_end AND coalesce(before < gen_start, true)) AS monotone FROM (SELECT *, lag(gen_end + part % 60) OVER (PARTITION BY tid ORDER BY ord) AS before FROM chain) GROUP BY tid")
def p04_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    moved = chain(spark, sf_dir)
    # stretched exons, so that some overlap the next one
    w = Window.partitionBy("tid").orderBy("ord")
    before = F.lag(F.col("gen_end") + F.col("part") % 60).over(w)
    return chains.is_monotone(moved.withColumn("gen_start", F.when(before >= F.col("gen_start"), F.lit(0)).otherwise(F.col("gen_start"))))


_ALIGN_SQL = "al AS (SELECT l_partkey AS grp, l_orderkey * 100 + l_linenumber AS id, round(l_discount * 10, 2) AS coverage, CAST(l_quantity AS INTEGER) AS length, CAST(l_suppkey % 90 AS INTEGER) AS gap, CAST(1 + l_suppkey % 5 AS INTEGER) AS n_exons FROM lineitem)"


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("grp"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
        F.round(F.col("l_discount") * 10, 2).alias("coverage"),
        F.col("l_quantity").cast("int").alias("length"),
        (F.col("l_suppkey") % 90).cast("int").alias("gap"),
        (1 + F.col("l_suppkey") % 5).cast("int").alias("n_exons"),
    )


@query(f"WITH {_ALIGN_SQL} SELECT grp, id, coverage FROM (SELECT *, max(coverage) OVER (PARTITION BY grp) - coverage AS d FROM al) WHERE coverage >= 0.35 AND d <= 0.05 AND d * length <= 100")
def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.coverage_filter(_alignments(spark, sf_dir), "grp").select("grp", "id", "coverage")


@query(f"WITH {_ALIGN_SQL} SELECT grp, id, gap FROM (SELECT *, min(gap) OVER (PARTITION BY grp) AS m FROM al) WHERE gap <= m + 20")
def p11_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.gap_filter(_alignments(spark, sf_dir), "grp").select("grp", "id", "gap")


@query(f"WITH {_ALIGN_SQL} SELECT grp, id FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM al) WHERE n <= 30")
def o07_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.cap_alignments(_alignments(spark, sf_dir), "grp", 30).select("grp", "id")


@query(f"WITH {_ALIGN_SQL}, u AS (SELECT DISTINCT * FROM al) SELECT grp, id, coverage, n_exons FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY coverage DESC, n_exons, id) AS r FROM u) WHERE r = 1")
def a09_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.best_alignment(_alignments(spark, sf_dir).distinct(), "grp", "id").select("grp", "id", "coverage", "n_exons")


_SHAPE_SQL = f"{CHAIN}, shapes AS (SELECT locus, tid, string_agg(gen_start || '-' || gen_end, ',' ORDER BY ord) AS exons FROM chain GROUP BY locus, tid)"


@query(f"WITH {_SHAPE_SQL} SELECT locus, exons, min(tid) AS tid, count(*) AS copies FROM shapes GROUP BY locus, exons")
def p14_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.distinct_chains(chain(spark, sf_dir), ["locus"])


@query(f"WITH {CHAIN} SELECT tid, ord FROM chain WHERE tid NOT IN (SELECT tid FROM chain WHERE gen_end - gen_start + 1 < 20)")
def p19_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.without_tiny_exons(chain(spark, sf_dir), least=20).select("tid", "ord")


_KEY_SQL = f"""{CHAIN}, sites AS (SELECT locus, tid, count(*) AS n_exons, min(gen_start) AS left_end, max(gen_end) AS right_end, string_agg(gen_start || ',' || gen_end, ',' ORDER BY ord) AS s FROM chain GROUP BY locus, tid),
    keyed AS (SELECT locus, tid, n_exons, left_end, right_end, CASE WHEN n_exons > 1 THEN substr(s, length(CAST(left_end AS VARCHAR)) + 2, length(s) - length(CAST(left_end AS VARCHAR)) - length(CAST(right_end AS VARCHAR)) - 2) ELSE 'single:' || tid END AS site_key FROM sites)"""


@query(f"WITH {_KEY_SQL} SELECT * FROM keyed")
def c01_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.composition_key(chain(spark, sf_dir), ["locus"])


@query(f"WITH {_KEY_SQL} SELECT locus, site_key, min(tid) AS tid, max(n_exons) AS n_exons, min(left_end) AS left_end, max(right_end) AS right_end, count(*) AS support FROM keyed GROUP BY locus, site_key")
def c02_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.merge_compositions(chains.composition_key(chain(spark, sf_dir), ["locus"]), ["locus"])


@query()
def c02_ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third transcript ends in poly-A, every seventh is a RefSeq."""
    keyed = chains.composition_key(chain(spark, sf_dir), ["locus"])
    return chains.merge_in_order(keyed.withColumn("polya", F.col("tid") % 3 == 0).withColumn("refseq", F.col("tid") % 7 == 0), ["locus"])


@query(
    f"""WITH {CHAIN}, t AS (SELECT locus, tid, tid % 7 = 0 AS refseq, string_agg(gen_start || '-' || gen_end, ',' ORDER BY ord) AS exons FROM chain GROUP BY locus, tid)
    SELECT locus, exons, min(tid) AS tid, bool_or(refseq) AS refseq, CAST(sum(tid % 3 + 1) AS BIGINT) AS support FROM t GROUP BY locus, exons, CASE WHEN refseq THEN tid END"""
)
def c05_final_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir).withColumn("refseq", F.col("tid") % 7 == 0).withColumn("support", F.col("tid") % 3 + 1)
    return chains.final_groups(rows, ["locus"])


_IDENTITY_SQL = f"""{CHAIN}, exons AS (SELECT *, substr('ACGTACGTA', CAST(part % 4 + 1 AS INTEGER), 4) AS seq FROM chain),
    numbers AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY gen_start, gen_end, seq) AS exon_no FROM (SELECT DISTINCT locus, gen_start, gen_end, seq FROM exons))"""


def _with_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).withColumn("seq", F.substring(F.lit("ACGTACGTA"), (F.col("part") % 4 + 1).cast("int"), F.lit(4)))


@query(f"WITH {_IDENTITY_SQL} SELECT locus, gen_start, gen_end, seq, CAST(exon_no AS INTEGER) AS exon_no FROM numbers")
def t01_exon_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.exon_numbers(_with_sequence(spark, sf_dir), ["locus"], ["seq"])


@query(f"WITH {_IDENTITY_SQL} SELECT tid, ord, CAST(exon_no AS INTEGER) AS exon_no FROM exons JOIN numbers USING (locus, gen_start, gen_end, seq)")
def t12_exon_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_sequence(spark, sf_dir)
    return chains.covering_rows(rows, chains.exon_numbers(rows, ["locus"], ["seq"]), ["locus"], ["seq"]).select("tid", "ord", "exon_no")


@query(
    f"""WITH {CHAIN}, m AS (SELECT *, min(ord) OVER (PARTITION BY tid) AS lo, max(ord) OVER (PARTITION BY tid) AS hi FROM chain),
    be AS (SELECT locus, gen_end, min(gen_start) AS ws FROM m WHERE ord > lo AND ord < hi GROUP BY ALL), bs AS (SELECT locus, gen_start, max(gen_end) AS we FROM m WHERE ord > lo AND ord < hi GROUP BY ALL)
    SELECT locus, tid, ord, CASE WHEN lo < hi AND ord = lo THEN coalesce(ws, gen_start) ELSE gen_start END AS gen_start, CASE WHEN lo < hi AND ord = hi THEN coalesce(we, gen_end) ELSE gen_end END AS gen_end
    FROM m LEFT JOIN be USING (locus, gen_end) LEFT JOIN bs USING (locus, gen_start)"""
)
def c04_outer_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.reduce_outer_exons(chain(spark, sf_dir), ["locus"])


@query(
    f"""WITH {CHAIN}, u AS (SELECT tid, CASE WHEN tid % 2 = 0 THEN gen_start + 999 ELSE 200000 - gen_end + 1 END AS abs_start, CASE WHEN tid % 2 = 0 THEN gen_end + 999 ELSE 200000 - gen_start + 1 END AS abs_end, ord FROM chain) SELECT * FROM u"""
)
def f20_coord_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("tid") % 2 == 0, 1).otherwise(-1)
    at = S.lift(sign, F.lit(1000), F.lit(200000), "gen_start", "gen_end")
    return chain(spark, sf_dir).select("tid", "ord", at["start"].alias("abs_start"), at["end"].alias("abs_end"))


# Introns with types, frequencies and support
_TYPED_SQL = f"{INTRONS}, typed AS (SELECT locus, i_start, i_end, count(*) AS support, CAST((i_start // 10) % 3 AS INTEGER) AS agree_type, CAST((i_end // 10) % 11 AS INTEGER) AS frequency FROM introns GROUP BY locus, i_start, i_end)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = chains.intron_support(chains.introns(chain(spark, sf_dir)), ["locus"])
    return support.withColumn("agree_type", (F.floor(F.col("i_start") / 10) % 3).cast("int")).withColumn("frequency", (F.floor(F.col("i_end") / 10) % 11).cast("int"))


def _agree_sql(where: str, order: str) -> str:
    return f"""WITH {_TYPED_SQL}, p AS (SELECT a.locus, a.i_start, a.i_end, b.i_start AS t_start, b.i_end AS t_end, row_number() OVER (PARTITION BY a.locus, a.i_start, a.i_end ORDER BY {order} b.i_start, b.i_end) AS r
      FROM typed a JOIN typed b ON a.locus = b.locus AND abs(a.i_start - b.i_start) < 12 AND abs(a.i_end - b.i_end) < 12 AND (a.i_start <> b.i_start OR a.i_end <> b.i_end) WHERE {where})
      SELECT locus, i_start, i_end, t_start, t_end FROM p WHERE r = 1"""


_MOVES = ["locus", "i_start", "i_end", "t_start", "t_end"]


@query(_agree_sql("a.agree_type = 1 AND b.agree_type = 0", ""))
def j06_band_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agree_with_reference(_typed(spark, sf_dir), ["locus"]).select(_MOVES)


@query(_agree_sql("a.agree_type = 1 AND b.agree_type = 1 AND b.frequency > a.frequency", "b.frequency DESC,"))
def j07_better_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agree_with_better(_typed(spark, sf_dir), ["locus"], 1).select(_MOVES)


@query(_agree_sql("a.agree_type = 2 AND b.agree_type < 2", "b.agree_type,"))
def j08_agree_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agree_with_any(_typed(spark, sf_dir), ["locus"]).select(_MOVES)


@query(_agree_sql("a.agree_type = 2 AND b.agree_type = 2 AND b.frequency > a.frequency", "b.frequency DESC,"))
def j10_better_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agree_with_better(_typed(spark, sf_dir), ["locus"], 2).select(_MOVES)


@query(
    _agree_sql("a.agree_type = 1 AND b.agree_type = 0", "").replace(
        "SELECT locus, i_start, i_end, t_start, t_end FROM p WHERE r = 1",
        "SELECT locus, coalesce(t_start, i_start) AS i_start, coalesce(t_end, i_end) AS i_end, CAST(sum(support) AS BIGINT) AS support FROM typed LEFT JOIN (SELECT locus, i_start, i_end, t_start, t_end FROM p WHERE r = 1) USING (locus, i_start, i_end) GROUP BY 1, 2, 3",
    )
)
def j06_support_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir)
    return consensus.after_agreement(rows, consensus.agree_with_reference(rows, ["locus"]), ["locus"])


# Joins of isoforms, introns and exons
@query(f"WITH {INTRONS}, known AS (SELECT locus, i_start, i_end, count(*) AS support FROM introns GROUP BY ALL HAVING count(*) > 1) SELECT tid, ord, support FROM introns JOIN known USING (locus, i_start, i_end)")
def j14_isoform_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir)
    known = chains.intron_support(chains.introns(rows), ["locus"]).filter("support > 1")
    return matching.isoform_introns(rows, known, ["locus"]).select("tid", "ord", "support")


@query(
    f"""WITH {INTRONS} SELECT i.tid, i.i_start, i.i_end, a.ord AS left_ord, b.ord AS right_ord FROM introns i JOIN chain a ON a.tid = i.tid AND a.gen_end = i.i_start - 1 JOIN chain b ON b.tid = i.tid AND b.gen_start = i.i_end + 1"""
)
def j15_supporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.supporting_exons(chain(spark, sf_dir))


@query(
    f"""WITH {CHAIN}, l AS (SELECT locus, tid, max(gen_end) AS right_end FROM chain GROUP BY ALL), pas AS (SELECT locus, right_end AS site FROM l WHERE tid % 97 = 0)
    SELECT tid, right_end FROM l WHERE EXISTS (SELECT 1 FROM pas WHERE pas.locus = l.locus AND abs(site - right_end) <= 30)"""
)
def j16_semi_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = chains.summaries(chain(spark, sf_dir), ["locus"]).select("locus", "tid", "right_end")
    sites = last.filter("tid % 97 = 0").select("locus", F.col("right_end").alias("site"))
    return matching.near_sites(last, sites, ["locus"], "right_end").select("tid", "right_end")


@query(f"WITH {INTRONS} SELECT DISTINCT i_start, i_end FROM introns WHERE locus < 25 EXCEPT SELECT i_start, i_end FROM introns WHERE locus >= 25")
def u02_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chains.introns(chain(spark, sf_dir))
    return matching.only_in_first(rows.filter("locus < 25"), rows.filter("locus >= 25"))


@query(f"WITH {INTRONS} SELECT i_start, i_end FROM introns WHERE locus < 25 INTERSECT SELECT i_start, i_end FROM introns WHERE locus >= 25")
def u03_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chains.introns(chain(spark, sf_dir))
    return matching.in_both(rows.filter("locus < 25"), rows.filter("locus >= 25"))


# Covers: alternatives of a transcript are its supplier and part readings
_ALT_SQL = "alts AS (SELECT DISTINCT l_partkey % 100 AS locus, l_orderkey AS tid, l_linenumber % 3 AS alt, l_suppkey % 12 AS \"window\" FROM lineitem)"


def _alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_partkey") % 100).alias("locus"), F.col("l_orderkey").alias("tid"), (F.col("l_linenumber") % 3).alias("alt"), (F.col("l_suppkey") % 12).alias("window")).distinct()


@query(f"WITH {_ALT_SQL} SELECT locus, tid, alt, string_agg(CAST(\"window\" AS VARCHAR), ',' ORDER BY \"window\") AS windows FROM alts GROUP BY locus, tid, alt")
def a04_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.incidence(_alternatives(spark, sf_dir), ["locus"]).withColumn("windows", F.array_join(F.transform("windows", lambda x: x.cast("string")), ","))


@query(
    f"""WITH {_ALT_SQL}, n AS (SELECT locus, tid, count(DISTINCT alt) AS n FROM alts GROUP BY ALL), u AS (SELECT locus, tid, "window", count(DISTINCT alt) AS k FROM alts GROUP BY ALL)
    SELECT DISTINCT locus, "window" FROM u JOIN n USING (locus, tid) WHERE k = n"""
)
def a05_essential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.essential_windows(_alternatives(spark, sf_dir), ["locus"])


_SMALL_SQL = "alts AS (SELECT DISTINCT l_partkey AS locus, l_orderkey % 4 AS tid, l_linenumber % 2 AS alt, l_suppkey % 9 AS \"window\" FROM lineitem)"


@query(
    f"""WITH {_SMALL_SQL}, masks AS (SELECT locus, tid, alt, bit_or(1 << CAST("window" AS INTEGER)) AS m FROM alts GROUP BY ALL), every AS (SELECT CAST(unnest(range(512)) AS INTEGER) AS c),
    needs AS (SELECT locus, count(DISTINCT tid) AS n FROM masks GROUP BY locus),
    ok AS (SELECT locus, c, count(DISTINCT tid) AS t FROM masks, every WHERE m & c = m GROUP BY locus, c),
    full_ AS (SELECT locus, min(bit_count(c)) AS cover_size FROM ok JOIN needs USING (locus) WHERE t = n GROUP BY locus)
    SELECT locus, CAST(cover_size AS BIGINT) AS cover_size FROM full_"""
)
def g05_min_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    alts = rows.select(F.col("l_partkey").alias("locus"), (F.col("l_orderkey") % 4).alias("tid"), (F.col("l_linenumber") % 2).alias("alt"), (F.col("l_suppkey") % 9).alias("window")).distinct()
    return cover.minimum_cover(alts, ["locus"]).groupBy("locus").agg(F.count("*").alias("cover_size"))


# Graphs: exons of a locus as vertices; an edge where one follows another in a chain
_GRAPH_SQL = """edges AS (SELECT DISTINCT l_partkey % 40 AS grp, l_suppkey % 30 AS src, l_suppkey % 30 + 1 + l_quantity::BIGINT % 7 AS dst FROM lineitem)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    src = F.col("l_suppkey") % 30
    return rows.select((F.col("l_partkey") % 40).alias("grp"), src.alias("src"), (src + 1 + F.col("l_quantity").cast("bigint") % 7).alias("dst")).distinct()


@query(f"WITH {_GRAPH_SQL} SELECT DISTINCT grp, src AS node FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.grp = e.grp AND x.dst = e.src)")
def g10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.sources(_edges(spark, sf_dir), ["grp"])


@query(f"WITH {_GRAPH_SQL} SELECT grp, src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges a JOIN edges b ON a.grp = b.grp AND a.dst = b.src WHERE a.grp = e.grp AND a.src = e.src AND b.dst = e.dst)")
def g04_transitive_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.transitive_reduction(_edges(spark, sf_dir), ["grp"])


_SPARSE_SQL = """sparse AS (SELECT DISTINCT l_partkey AS grp, l_suppkey % 9 AS src, l_suppkey % 9 + 1 + l_linenumber % 3 AS dst FROM lineitem)"""


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.col("l_suppkey") % 9
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("grp"), src.alias("src"), (src + 1 + F.col("l_linenumber") % 3).alias("dst")).distinct()


@query(
    f"""WITH RECURSIVE {_SPARSE_SQL}, walk(grp, node, path) AS (
      SELECT DISTINCT grp, src, CAST(src AS VARCHAR) FROM sparse e WHERE NOT EXISTS (SELECT 1 FROM sparse x WHERE x.grp = e.grp AND x.dst = e.src)
      UNION ALL SELECT w.grp, e.dst, w.path || ',' || e.dst FROM walk w JOIN sparse e ON e.grp = w.grp AND e.src = w.node)
    SELECT grp, path FROM walk w WHERE NOT EXISTS (SELECT 1 FROM sparse e WHERE e.grp = w.grp AND e.src = w.node)"""
)
def g11_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graphs.paths(_sparse(spark, sf_dir), ["grp"])
    return found.select("grp", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query(
    f"""WITH RECURSIVE {_SPARSE_SQL}, reach(grp, src, dst) AS (SELECT grp, src, dst FROM sparse UNION SELECT r.grp, r.src, e.dst FROM reach r JOIN sparse e ON e.grp = r.grp AND e.src = r.dst) SELECT * FROM reach"""
)
def g09_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.closure(_sparse(spark, sf_dir), ["grp"])


@query(
    f"""WITH RECURSIVE {_SPARSE_SQL}, walk(grp, node, level) AS (
      SELECT DISTINCT grp, src, 0 FROM sparse e WHERE NOT EXISTS (SELECT 1 FROM sparse x WHERE x.grp = e.grp AND x.dst = e.src)
      UNION SELECT w.grp, e.dst, w.level + 1 FROM walk w JOIN sparse e ON e.grp = w.grp AND e.src = w.node)
    SELECT grp, node, max(level) AS level FROM walk GROUP BY grp, node"""
)
def o05_topological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.topological_level(_sparse(spark, sf_dir), ["grp"])


@query(
    f"""WITH {_SPARSE_SQL}, v AS (SELECT DISTINCT grp, src AS node, src % 4 + 15 AS l FROM sparse), low AS (SELECT grp, count(*) AS vertices, min(l) AS shortest FROM v GROUP BY grp),
    often AS (SELECT grp, count(*) FILTER (l = shortest) AS shortest_count FROM v JOIN low USING (grp) GROUP BY grp), n AS (SELECT grp, count(*) AS edges FROM sparse GROUP BY grp)
    SELECT grp, vertices, shortest, shortest_count, edges, NOT (vertices < 5 OR edges < 4) AND ((vertices > 80 AND shortest_count > 0.4 * vertices) OR edges > 5 * vertices OR vertices > 2 * (60.0 / 15) OR (vertices > 60.0 / 15 AND vertices >= 50) OR edges > 1000 OR vertices > 2000) AS too_complex
    FROM low JOIN often USING (grp) JOIN n USING (grp)"""
)
def a07_graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge_rows = _sparse(spark, sf_dir)
    vertices = edge_rows.select("grp", F.col("src").alias("node")).distinct().withColumn("l", F.col("node") % 4 + 15)
    stats = graphs.statistics(vertices, edge_rows, ["grp"]).withColumn("length", F.lit(60))
    return graphs.too_complex(stats).drop("length")


@query(
    f"""WITH {CHAIN}, w AS (SELECT *, ord = max(ord) OVER (PARTITION BY tid) AND tid % 2 = 0 AS tail FROM chain)
    SELECT locus, gen_start, gen_end, bool_and(tail) AS polya FROM w GROUP BY locus, gen_start, gen_end"""
)
def c03_polya(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    last = F.max("ord").over(Window.partitionBy("tid"))
    return refine.polya_flags(chain(spark, sf_dir).withColumn("tail", (F.col("ord") == last) & (F.col("tid") % 2 == 0)), ["locus"])


_NEAR_SQL = f"""{CHAIN}, n AS (SELECT *, CASE WHEN gen_start - lag(gen_end) OVER (PARTITION BY tid ORDER BY ord) - 1 <= 55 THEN 0 ELSE 1 END AS fresh FROM chain)"""


@query(f"WITH {_NEAR_SQL}, r AS (SELECT *, sum(fresh) OVER (PARTITION BY tid ORDER BY ord) AS run FROM n) SELECT tid, CAST(run AS INTEGER) AS ord, min(gen_start) AS gen_start, max(gen_end) AS gen_end FROM r GROUP BY tid, run")
def p02_join_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir).select("tid", F.col("gen_start").alias("est_start"), F.col("gen_end").alias("est_end"), "gen_start", "gen_end")
    return refine.join_exons(rows, ["tid"], most=55).select("tid", "ord", "gen_start", "gen_end")


@query(
    f"""WITH {_SPARSE_SQL}, o AS (SELECT grp, src AS node, count(*) AS n FROM sparse GROUP BY ALL), e AS (SELECT DISTINCT grp, dst AS node, dst % 3 AS exons FROM sparse)
    SELECT grp, node, exons FROM (SELECT *, row_number() OVER (PARTITION BY grp, exons ORDER BY coalesce(n, 0) DESC, node) AS r FROM e LEFT JOIN o USING (grp, node)) WHERE r = 1"""
)
def g13_richer_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge_rows = _sparse(spark, sf_dir)
    ends = edge_rows.select("grp", F.col("dst").alias("node"), (F.col("dst") % 3).alias("exons")).distinct()
    return refine.keep_richer_ends(ends, edge_rows, ["grp"])


@query()
def p09_relaxed_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of six neighbouring orders as alignments of one transcript."""
    exons = F.array_sort(F.collect_list(F.struct("ord", "gen_start", "gen_end")))
    rows = chain(spark, sf_dir).groupBy(F.expr("tid DIV 6").alias("grp"), F.col("tid").alias("fact_no")).agg(F.transform(exons, lambda e: F.struct(e["gen_start"].alias("gen_start"), e["gen_end"].alias("gen_end"))).alias("exons"))
    kept = refine.without_contained_alignments(rows, ["grp"])
    return kept.withColumn("exons", F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["gen_start"], e["gen_end"])), ","))
