"""Queries on sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import sequence as S
from ..operators import align, refine, seeds
from ..session import written
from ..sources import fasta, records
from .tables import SEQ, sequences, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _per_doc(name: str, sql: str, columns: Callable[[], dict[str, Column]], rows: str = "seq") -> None:
    """A query that adds columns to each sequence; ``rows`` is the SQL's FROM."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sequences(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in columns().items()))

    QUERIES[name] = run
    SQL[name] = f"WITH {SEQ} SELECT doc_id, {sql} FROM {rows}"


@query(
    r"""SELECT page_id, nullif(regexp_extract(h, '/(?:gb|GB)=([^ /]+)', 1), '') AS gb, nullif(regexp_extract(h, '/clone_end=([^ /'']+)', 1), '') AS clone_end,
    CAST(CASE WHEN regexp_extract(h, '/clone_end=([^ /'']+)', 1) = '5' THEN -1 ELSE 1 END AS INTEGER) AS strand
    FROM (SELECT page_id, '/gb=' || regexp_extract(url, '://([^/?#]*)', 1) || '/clone_end=' || CASE WHEN page_id % 3 = 0 THEN '3' WHEN page_id % 3 = 1 THEN '5' ELSE '' END || '''' AS h FROM pages)"""
)
def s03_accession(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("page_id") % 3 == 0, "3").when(F.col("page_id") % 3 == 1, "5").otherwise("")
    head = F.concat(F.lit("/gb="), F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/clone_end="), end, F.lit("'"))
    return table(spark, sf_dir, "pages").select("page_id", head.alias("h")).select("page_id", fasta.accession("h").alias("gb"), fasta.clone_end("h").alias("clone_end"), fasta.strand("h").alias("strand"))


@query(
    """SELECT c_custkey, CASE WHEN ok THEN 'chr' || c_nationkey ELSE 'unknown' END AS chrom, CASE WHEN ok THEN c_custkey * 10 ELSE 1 END AS abs_start,
    CASE WHEN ok THEN c_custkey * 10 + 99 ELSE 100 END AS abs_end, CAST(CASE WHEN ok THEN CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END ELSE 1 END AS INTEGER) AS strand
    FROM (SELECT *, c_custkey % 5 <> 0 AND c_custkey > 0 AS ok FROM customer)"""
)
def s02_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    sign = F.when(k % 2 == 0, "1").otherwise("-1")
    whole = F.concat_ws(":", F.concat(F.lit("chr"), F.col("c_nationkey")), k * 10, k * 10 + 99, sign)
    head = F.when(k % 5 == 0, F.concat(whole, F.lit(":x"))).otherwise(whole)
    return table(spark, sf_dir, "customer").select("c_custkey", fasta.locus_header(head, F.lit(100).cast("bigint")).alias("h")).select("c_custkey", "h.*")


_REVCOMP = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_per_doc("f01_revcomp", f"{_REVCOMP} AS revcomp", lambda: {"revcomp": S.reverse_complement("seq")})


def _fields(column: Column, *names: str) -> dict[str, Column]:
    return {n: column[n] for n in names}


_per_doc(
    "f03_trim",
    "regexp_replace(regexp_replace(s, '^N+', ''), 'N+$', '') AS seq, CAST(length(regexp_extract(s, '^(N*)', 1)) AS INTEGER) AS pref_n, CAST(length(regexp_extract(regexp_replace(s, '^N+', ''), '(N*)$', 1)) AS INTEGER) AS suff_n",
    lambda: _fields(S.trim_n(F.translate(F.concat(F.substring("seq", 1, 3), "seq", F.substring("seq", 1, 2)), "A", "N")), "seq", "pref_n", "suff_n"),
    rows="(SELECT doc_id, translate(substr(seq, 1, 3) || seq || substr(seq, 1, 2), 'A', 'N') AS s FROM seq)",
)
_per_doc("f04_substring", "substr(seq, 1, 7) AS head, substr(seq, 11, 20) AS middle", lambda: {"head": S.substring0("seq", F.lit(-3), F.lit(10)), "middle": S.substring0("seq", F.lit(10), F.lit(20))})
_per_doc("f05_case", "lower(reverse(seq)) AS flipped", lambda: {"flipped": F.lower(F.reverse("seq"))})
_per_doc(
    "f29_flanks",
    "substr(seq, 6, 15) AS donor_suffix, substr(seq, 21, 20) AS intron_prefix, substr(seq, 41, 20) AS intron_suffix, substr(seq, 61, 15) AS acceptor_prefix, substr(seq, 21, 2) || substr(seq, 59, 2) AS pattern",
    lambda: _fields(S.flanks("seq", F.lit(21), F.lit(60)), "donor_suffix", "intron_prefix", "intron_suffix", "acceptor_prefix", "pattern"),
)


@query(
    f"""WITH {SEQ}, pairs AS (SELECT doc_id, substr(seq, i, 2) AS pair, count(*) AS n FROM (SELECT doc_id, seq, unnest(range(1, length(seq))) AS i FROM seq WHERE length(seq) > 2) GROUP BY ALL),
    s AS (SELECT doc_id, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS equal FROM pairs GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN length(seq) <= 2 THEN 0.0 ELSE 10.0 * equal / (length(seq) - 2) / length(seq) END, 9) AS dust FROM seq LEFT JOIN s USING (doc_id)"""
)
def f06_dust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("doc_id", F.round(S.dust_score("seq"), 9).alias("dust"))


_per_doc(
    "f08_polya_signal",
    """doc_id % 12 >= 8 AND NOT (regexp_matches(substr(seq, greatest(e - 8, 1), 20), 'A{6}') OR length(regexp_replace(substr(seq, e + 1, 10), '[^A]', '', 'g')) >= 7) AS polya,
    regexp_matches(substr(seq, greatest(e - 39, 1), least(40, e) + 5), 'AATAAA|ATTAAA') AS pas""",
    lambda: _fields(S.polya_signal(F.concat(F.repeat(F.lit("A"), (F.col("doc_id") % 12).cast("int")), F.lit("C")), "seq", F.least(F.lit(200), F.length("seq"))), "polya", "pas"),
    rows="(SELECT *, least(200, length(seq)) AS e FROM seq)",
)

# A small matrix for the queries; real ones are a table that the caller gives.
_DEMO = [(0, i, b, round(0.1 + 0.2 * ((i + k) % 4), 2)) for i in range(12) for k, b in enumerate("ACGT")]
_DEMO_SQL = "pwm(matrix, pos, base, p) AS (VALUES " + ", ".join(f"({m}, {i}, '{b}', {p}::DOUBLE)" for m, i, b, p in _DEMO) + ")"
_WEIGHTS_SQL = f"""{_DEMO_SQL}, weights AS (SELECT matrix, pos, 100 / ln(5) * (sum((p + 1e-5) * ln(p + 1e-5)) + ln(5)) AS c, max(p + 1e-5) AS top FROM pwm GROUP BY ALL),
    best AS (SELECT matrix, sum(c * top) AS most FROM weights GROUP BY ALL)"""


def _demo_matrix(spark: SparkSession) -> DataFrame:
    return spark.sql("VALUES " + ", ".join(f"({m}, {i}, '{b}', CAST({p} AS DOUBLE))" for m, i, b, p in _DEMO) + " AS pwm(matrix, pos, base, p)")


@query(
    f"""WITH {SEQ}, {_WEIGHTS_SQL}
    SELECT doc_id, round(sum(c * (p + 1e-5)) / any_value(most), 9) AS score FROM (SELECT doc_id, i, substr(seq, i + 1, 1) AS base FROM (SELECT *, unnest(range(12)) AS i FROM seq WHERE length(seq) >= 12)) s
    JOIN pwm ON pwm.pos = i AND pwm.base = s.base JOIN weights USING (matrix, pos) JOIN best USING (matrix) GROUP BY doc_id"""
)
def f09_pwm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    motifs = sequences(spark, sf_dir).filter(F.length("seq") >= 12).select("doc_id", F.substring("seq", 1, 12).alias("motif"), F.lit(0).alias("matrix"))
    return scoring.pwm_scores(motifs, _demo_matrix(spark), ["doc_id"]).select("doc_id", F.round("score", 9).alias("score"))


_values = ", ".join(f"('{p}', {n})" for p, n in S.FREQUENCIES.items())
_per_doc(
    "f10_pattern_freq",
    "CAST(coalesce(n, 0) AS INTEGER) AS frequency",
    lambda: {"frequency": S.pattern_frequency(F.substring("seq", 1, 2), F.substring("seq", -2, 2))},
    rows=f"(SELECT doc_id, substr(seq, 1, 2) || right(seq, 2) AS k FROM seq) LEFT JOIN (VALUES {_values}) v(k, n) USING (k)",
)


@query(
    f"""WITH {SEQ}, {_WEIGHTS_SQL}, cells AS (SELECT pos, base, c * (p + 1e-5) / most AS v FROM pwm JOIN weights USING (matrix, pos) JOIN best USING (matrix)),
    w AS (SELECT list(v ORDER BY pos, base) AS w FROM cells),
    letters AS (SELECT doc_id, i, strpos('ACGT', b) AS k FROM (SELECT doc_id, unnest(b) AS b, generate_subscripts(b, 1) AS i FROM (SELECT doc_id, string_split(seq, '') AS b FROM seq WHERE length(seq) >= 60))),
    scored AS (
      SELECT doc_id, i AS start, round({" + ".join(f"w[{4 * i} + lead(k, {i}) OVER o]" for i in range(12))}, 9) AS score
      FROM letters, w WINDOW o AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, CAST(arg_max(start, (score, start)) AS INTEGER) AS position, max(score) AS score FROM scored WHERE score IS NOT NULL GROUP BY doc_id"""
)
def f11_best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).filter(F.length("seq") >= 60).select("doc_id", "seq", F.lit(0).alias("matrix"))
    best = scoring.best_window(rows, _demo_matrix(spark), ["doc_id"], 12, F.lit(1), F.length("seq") - 11)
    return best.select("doc_id", "position", "score")


_per_doc(
    "f13_canonical",
    "regexp_matches(substr(seq, 3), '^(GT.*AG|gt.*ag)$', 's') AS canonical",
    lambda: {"canonical": S.is_canonical(F.expr("substring(seq, 3)"))},
)


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS edits FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def f15_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", S.edit_distance("p_name", "other").cast("bigint").alias("edits"))


@query("SELECT a.c_custkey, levenshtein(a.c_name, b.c_name) <= 2 AS near FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 7")
def f16_edit_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    q = p.select((F.col("c_custkey") - 7).alias("c_custkey"), F.col("c_name").alias("other"))
    return p.join(q, "c_custkey").select("c_custkey", S.within_edits("c_name", "other", 2).alias("near"))


@query(
    f"""WITH {SEQ}, s AS (SELECT doc_id, seq FROM seq WHERE length(seq) >= 60),
    b AS (SELECT doc_id, max(CASE WHEN substr(seq, 21 - k, k) = substr(seq, 41 - k, k) THEN k ELSE 0 END) AS k FROM (SELECT *, unnest(range(0, 21)) AS k FROM s) GROUP BY doc_id),
    a AS (SELECT doc_id, max(CASE WHEN substr(seq, 21, k) = substr(seq, 41, k) THEN k ELSE 0 END) AS k FROM (SELECT *, unnest(range(0, least(20, length(seq) - 40) + 1)) AS k FROM s) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN b.k + a.k > 0 THEN substr(seq, 21 - b.k, b.k) || substr(seq, 21, a.k) ELSE '.' END AS repeat FROM s JOIN b USING (doc_id) JOIN a USING (doc_id)"""
)
def f23_junction_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).filter(F.length("seq") >= 60).select("doc_id", S.junction_repeat("seq", F.lit(21), F.lit(40)).alias("repeat"))


_per_doc("f24_codons", "substr(seq, 4, 3) = 'ATG' AS starts, substr(seq, 4, 3) IN ('TAA', 'TAG', 'TGA') AS stops", lambda: {"starts": S.is_start(F.substring("seq", 4, 3)), "stops": S.is_stop(F.substring("seq", 4, 3))})
_per_doc("f25_context", "CAST(CAST(substr(seq, 7, 1) IN ('A', 'G') AS INTEGER) + CAST(substr(seq, 13, 1) IN ('A', 'G') AS INTEGER) AS INTEGER) AS context", lambda: {"context": S.kozak_context("seq", F.lit(10))})
_per_doc(
    "f26_label",
    "CASE WHEN doc_id >= 702 THEN chr(CAST(97 + ((doc_id // 26 - 1) // 26 - 1) % 26 AS INTEGER)) ELSE '' END || CASE WHEN doc_id >= 26 THEN chr(CAST(97 + (doc_id // 26 - 1) % 26 AS INTEGER)) ELSE '' END || chr(CAST(97 + doc_id % 26 AS INTEGER)) AS label",
    lambda: {"label": S.alpha_label(F.col("doc_id") + 1)},
)
_per_doc("f27_allowed_errors", "CAST(greatest(1, ceil(length(seq) * CASE WHEN length(seq) > 100 THEN 0.03 WHEN length(seq) > 50 THEN 0.035 ELSE 0.04 END)) AS INTEGER) AS most", lambda: {"most": S.allowed_errors(F.length("seq"))})

# Longest open reading frame; starts with a Kozak context first
_ORF_SQL = f"""WITH {SEQ}, letters AS (SELECT doc_id, unnest(s) AS b, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(seq, '') AS s FROM seq WHERE length(seq) >= 3)),
    codons AS (SELECT doc_id, i, (i - 1) % 3 AS f, b || lead(b, 1) OVER o || lead(b, 2) OVER o AS c, coalesce(lag(b, 3) OVER o IN ('A', 'G'), false) OR coalesce(lead(b, 3) OVER o IN ('A', 'G'), false) AS good FROM letters WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    marked AS (SELECT * FROM codons WHERE c IN ('ATG', 'TAA', 'TAG', 'TGA')),
    next AS (SELECT *, min(CASE WHEN c <> 'ATG' THEN i END) OVER (PARTITION BY doc_id, f ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM marked),
    orfs AS (SELECT doc_id, i AS s, stop + 2 AS e, good FROM next WHERE c = 'ATG' AND stop IS NOT NULL AND stop + 3 - i >= 30)
    SELECT doc_id, CAST(s AS INTEGER) AS orf_start, CAST(e AS INTEGER) AS orf_end, CAST((e - s + 1) // 3 - 1 AS INTEGER) AS protein_length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY good DESC, e - s DESC, s) AS r FROM orfs) WHERE r = 1"""


@query(_ORF_SQL)
def t07_longest_orf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import cds

    return cds.longest_orf(sequences(spark, sf_dir), ["doc_id"], least=30)


@query(
    f"""WITH {SEQ}, chars AS (SELECT substr(seq, i, 1) AS base FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM seq))
    SELECT base, count(*) AS n FROM chars GROUP BY base"""
)
def a12_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select(F.explode(F.split("seq", "")).alias("base")).filter("base != ''").groupBy("base").agg(F.count("*").alias("n"))


K = 10
_PAIR_SQL = f"""{SEQ}, kmers AS (SELECT doc_id // 10 AS locus, doc_id, i - 1 AS at, substr(seq, i, {K}) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - {K} + 2)) AS i FROM seq)),
    hits AS (SELECT locus, a.doc_id AS est_id, b.doc_id AS gen_id, a.at AS p, b.at - a.at AS d FROM kmers a JOIN kmers b USING (locus, kmer) WHERE a.doc_id % 10 <> 0 AND b.doc_id % 10 = 0),
    runs AS (SELECT *, p - row_number() OVER (PARTITION BY est_id, gen_id, d ORDER BY p) AS run FROM hits),
    pairings AS (SELECT locus, est_id, gen_id, CAST(min(p) AS INTEGER) AS p, CAST(min(p) + d AS INTEGER) AS t, CAST(count(*) + {K} - 1 AS INTEGER) AS l FROM runs GROUP BY locus, est_id, gen_id, d, run)"""


def _pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of ten documents: the first is the genome, the others are its transcripts, so
    that loci grow in number with the table, not in size."""
    rows = sequences(spark, sf_dir).withColumn("locus", F.floor(F.col("doc_id") / 10))
    est = rows.filter("doc_id % 10 != 0").select("locus", F.col("doc_id").alias("est_id"), "seq")
    gen = rows.filter("doc_id % 10 = 0").select("locus", F.col("doc_id").alias("gen_id"), "seq")
    return seeds.seed_matches(est, gen, ["locus"], K)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairings without those of repeats; they are joined several times, so computed once."""
    return written(seeds.drop_low_complexity(written(_pairings(spark, sf_dir)), _GROUP))


@query(f"WITH {_PAIR_SQL} SELECT * FROM pairings")
def j01_seed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairings(spark, sf_dir)


_GROUP = ["locus", "est_id", "gen_id"]
_LOW_SQL = f"""{_PAIR_SQL}, kept AS (SELECT * FROM pairings b WHERE NOT EXISTS (
    SELECT 1 FROM pairings a WHERE a.est_id = b.est_id AND a.gen_id = b.gen_id AND (
      (a.p = b.p AND ((a.t < b.t AND b.t + b.l <= a.t + a.l) OR (b.t = a.t + 1 AND b.l = a.l))) OR (a.p + 1 = b.p AND a.t = b.t AND b.l <= a.l))))"""


@query(f"WITH {_LOW_SQL} SELECT * FROM kept")
def w02_lowcomplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.drop_low_complexity(written(_pairings(spark, sf_dir)), _GROUP)


_EDGE_SQL = f"""{_LOW_SQL}, edges AS (
    SELECT locus, est_id, gen_id, a.p AS p1, a.t AS t1, a.l AS l1, b.p AS p2, b.t AS t2, b.l AS l2 FROM kept a JOIN kept b USING (locus, est_id, gen_id)
    WHERE b.p > a.p AND b.t > a.t AND (
      ((a.p + a.l <= b.p AND b.p <= a.p + a.l + {2 * K + 1}) AND (a.t + a.l <= b.t OR ((a.t + {2 * K} <= b.t + b.l AND b.t < a.t + a.l AND (b.p - a.p) - (b.t - a.t) <= {2 * K + 1}) AND NOT (a.l >= {5 * K} AND a.t + a.l - b.t > 0.4 * a.l))))
      OR (NOT (a.p + a.l <= b.p AND b.p <= a.p + a.l + {2 * K + 1}) AND (a.p + {2 * K} <= b.p + b.l AND b.p < a.p + a.l) AND (a.t + a.l <= b.t OR (a.t + {2 * K} <= b.t + b.l AND b.t < a.t + a.l AND (b.p - a.p) - (b.t - a.t) <= {2 * K + 1})))))"""


@query(f"WITH {_EDGE_SQL} SELECT * FROM edges")
def j02_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.edges(_kept(spark, sf_dir), _GROUP, K)


@query(f"WITH {_EDGE_SQL} SELECT * FROM edges WHERE NOT ((t2 - t1 - l1) - (p2 - p1 - l1) > {2 * K + 3} AND (t2 - t1 - l1) - (p2 - p1 - l1) < 40)")
def g02_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.prune(j02_edges(spark, sf_dir), fl=2 * K + 1)


@query(
    f"""WITH {_EDGE_SQL}, v AS (SELECT kept.*, length(seq) AS n FROM kept JOIN seq ON est_id = doc_id),
    apart AS (SELECT * FROM edges WHERE p1 + l1 <= p2 AND t1 + l1 <= t2)
    SELECT locus, est_id, gen_id, p, t, l, 'source' AS kind FROM v WHERE p < n * 0.6 AND NOT EXISTS (SELECT 1 FROM apart x WHERE x.est_id = v.est_id AND x.gen_id = v.gen_id AND x.p2 = v.p AND x.t2 = v.t AND x.l2 = v.l)
    UNION ALL SELECT locus, est_id, gen_id, p, t, l, 'sink' FROM v WHERE p + l > n * 0.4 AND NOT EXISTS (SELECT 1 FROM apart x WHERE x.est_id = v.est_id AND x.gen_id = v.gen_id AND x.p1 = v.p AND x.t1 = v.t AND x.l1 = v.l)"""
)
def g01_source_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept(spark, sf_dir)
    length = sequences(spark, sf_dir).select(F.col("doc_id").alias("est_id"), F.length("seq").alias("length"))
    return seeds.ends(kept.join(length, "est_id"), seeds.edges(kept, _GROUP, K), _GROUP, rate=0.6)


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence with that of the document after it."""
    a = sequences(spark, sf_dir).select("doc_id", F.col("seq").alias("a"))
    b = sequences(spark, sf_dir).select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("b"))
    return a.join(b, "doc_id")


#: Alignments run on windows of so many bases, one row for each.
PIECE = 80


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_neighbours`` cut, over their whole lengths, into windows of PIECE bases: the
    n-th of one text with the n-th of the other (empty beyond the shorter one's end)."""
    parts = lambda c: F.regexp_extract_all(F.col(c), F.lit(f".{{1,{PIECE}}}"), 0)
    both = F.arrays_zip(parts("a").alias("a"), parts("b").alias("b"))
    rows = _neighbours(spark, sf_dir).select("doc_id", F.posexplode(both).alias("piece", "s"))
    return rows.select("doc_id", "piece", F.coalesce("s.a", F.lit("")).alias("a"), F.coalesce("s.b", F.lit("")).alias("b"))


def _interrupted() -> Column:
    """b between the halves of a, as an intron."""
    half = F.floor(F.length("a") / 2).cast("int")
    return F.concat(F.substring(F.col("a"), F.lit(1), half), F.col("b"), F.substring(F.col("a"), half + 1, F.length("a")))


@query()
def f02_tail_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    tailed = F.concat("seq", F.repeat(F.lit("A"), (F.col("doc_id") % 30).cast("int")))
    return sequences(spark, sf_dir).select("doc_id", align.masked(tailed).alias("m")).select("doc_id", "m.*")


@query()
def f17_border_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", "piece", align.split_border(F.col("a"), F.col("b"), 3).alias("s")).select("doc_id", "piece", "s.*")


@query()
def f18_gap_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", "piece", align.spliced(F.col("a"), _interrupted()).alias("s")).select("doc_id", "piece", "s.*")


@query()
def f19_global_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", "piece", align.aligned(F.col("a"), F.col("b")).alias("s")).select("doc_id", "piece", "s.*")


@query()
def f21_common_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", "piece", align.common_factor(F.col("a"), F.col("b")).alias("s")).select("doc_id", "piece", "s.*")


@query()
def f22_best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", "piece", align.cut(F.col("a"), F.col("b")).alias("s")).select("doc_id", "piece", "s.*")


@query()
def f28_best_affix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", "piece", align.affix(F.col("a"), F.col("b")).alias("s")).select("doc_id", "piece", "s.*")


@query()
def p12_splice_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", "piece", align.refined_junction(F.col("a"), _interrupted(), F.floor(F.length("a") / 2)).alias("s")).select("doc_id", "piece", "s.*")


_NEXT = f"{SEQ}, n AS (SELECT a.doc_id, a.seq AS a, b.seq AS b FROM seq a JOIN seq b ON b.doc_id = a.doc_id + 1)"


@query(f"WITH {_NEXT} SELECT doc_id, levenshtein(a, b) > greatest(1, ceil(length(a) * CASE WHEN length(a) > 100 THEN 0.03 WHEN length(a) > 50 THEN 0.035 ELSE 0.04 END)) AS noisy FROM n")
def p08_noisy_exon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("doc_id", align.noisy(F.col("a"), F.col("b")).alias("noisy"))


@query(f"WITH {SEQ} SELECT doc_id, n < 10 OR (n < 20 AND NOT (p IN ('GTAG', 'GCAG') AND e = 0)) AS dropped FROM (SELECT doc_id, doc_id % 30 AS n, substr(seq, 1, 2) || 'AG' AS p, doc_id % 2 AS e FROM seq)")
def p06_external_exon(spark: SparkSession, sf_dir: str) -> DataFrame:
    fails = align.external_exon_fails(F.col("doc_id") % 30, F.col("doc_id") % 2, F.concat(F.substring("seq", 1, 2), F.lit("AG")))
    return sequences(spark, sf_dir).select("doc_id", fails.alias("dropped"))


@query(
    f"""WITH {_NEXT}, m AS (SELECT doc_id, list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] = b[i]), false) AS k, least(length(a), length(b)) AS n FROM n)
    SELECT doc_id, CAST(CASE WHEN coalesce(k, 0) = 0 THEN n ELSE k - 1 END AS BIGINT) AS est_end, CAST(10 + CASE WHEN coalesce(k, 0) = 0 THEN n ELSE k - 1 END AS BIGINT) AS gen_end FROM m"""
)
def f07_tail_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = refine.extend_tail(F.lit(0), F.lit(10), F.col("a"), F.concat(F.lit("N" * 10), "b"))
    return _neighbours(spark, sf_dir).select("doc_id", grown.alias("g")).select("doc_id", "g.*")


@query(f"WITH {_NEXT} SELECT doc_id, substr(a, 1, 6) = substr(b, 1, 6) AS starts, right(a, 11) = right(b, 11) AS ends FROM n")
def p05_end_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("doc_id", refine.ends_match(F.col("a"), F.col("b")).alias("m")).select("doc_id", "m.*")


@query(f"WITH {_EDGE_SQL} SELECT *, (t2 - t1) - (p2 - p1) >= 50 AS intronic FROM edges")
def k05_edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.edge_table(j02_edges(spark, sf_dir))
