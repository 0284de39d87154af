"""From FASTA files to introns, isoforms and reports, for any number of loci at once.

Each step is a DataFrame keyed by locus; a process boundary of a classic pipeline is a
shuffle here, or nothing. Transcripts of a locus are matched to its genome by seeds; the
maximal paths of a transcript's graph of pairings give its alignments, whose ends are
trimmed, gaps filled, splice sites refined, and small exons joined or found; introns are
collected, moved to better ones near them, and chains are merged, filtered and reported.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import flanks, pattern_frequency, reverse_complement
from ..operators import align, chains, consensus, graphs, isoforms, paths, refine, repair, seeds, small_exons, splices
from ..session import cut_lineage
from ..sources import fasta, report


@dataclass(frozen=True)
class Config:
    """Parameters, checked when made."""

    min_factor_length: int = 15
    min_intron_length: int = 40
    max_intron_length: int = 0
    min_string_depth_rate: float = 0.2
    max_discarded_rate: float = 0.6
    min_coverage: float = 0.35
    max_difference_of_coverage: float = 0.05
    max_no_of_factorizations: int = 0
    pas_tolerance: int = 30

    def __post_init__(self):
        if self.min_factor_length < 4 or self.min_intron_length < 1 or self.max_intron_length < 0:
            raise ValueError("lengths must be positive, and seeds at least 4 long")
        if not all(0 <= x <= 1 for x in (self.min_string_depth_rate, self.max_discarded_rate, self.min_coverage, self.max_difference_of_coverage)):
            raise ValueError("rates lie between 0 and 1")


def loci(spark: SparkSession, path: str) -> DataFrame:
    """locus, chrom, abs_start, abs_end, strand and seq of each record of a FASTA file."""
    records = fasta.read(spark, path)
    return records.select(F.col("header").alias("locus"), fasta.locus_header("header", F.length("seq").cast("bigint")).alias("h"), F.upper("seq").alias("seq")).select("locus", "h.*", "seq")


_IDS = ["locus", "est_id"]
_EXONS = "array<struct<est_start: bigint, est_end: bigint, gen_start: bigint, gen_end: bigint>>"


def graph(pairings: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Pairings (ids, length, p, t, l) and edges of each transcript's graph.
    Transcripts whose graph is too complex are tried again with seeds one base longer, until
    none is, or the seed is as long as the transcript (G03, G04); a longer seed only leaves
    out pairings, so nothing is matched again. Twice as many lengths are tried in each round
    as in the one before, side by side, and the least that does counts: rounds are as many
    as doublings of the length, and not as bases."""
    low, tried, parts, open_ = config.min_factor_length, 1, [], pairings
    k, on = F.col("_k"), [*_IDS, "_k"]
    while True:
        high = low + tried - 1
        last = F.least(F.lit(high), "l", F.greatest(F.lit(low), F.col("length") - 3))
        rows = open_.filter(F.col("l") >= low).withColumn("_k", F.explode(F.sequence(F.lit(low), last)))
        kept = cut_lineage(seeds.drop_low_complexity(rows, [*on, "length"]))
        linked = cut_lineage(seeds.prune(seeds.edges(kept, on, k, config.max_intron_length), 2 * k + 1, config.min_intron_length))
        sizes = graphs.statistics(kept, linked, on).join(kept.groupBy(*on).agg(F.max("length").alias("length")), on)
        bad = graphs.too_complex(sizes, "length", k).filter((F.col("length") > k + 3) & F.col("too_complex"))
        run = F.filter(F.array_sort(F.collect_list("_k")), lambda x, i: x == low + i)
        least = cut_lineage(bad.groupBy(*_IDS).agg((low + F.size(run)).alias("_least")))
        chosen = lambda rows: rows.join(least, _IDS, "left").filter(k == F.coalesce("_least", F.lit(low))).drop("_k", "_least")  # noqa: B023, E731
        parts.append((chosen(kept), chosen(linked)))
        again = least.filter(F.col("_least") > high).select(*_IDS)
        if again.isEmpty():
            break
        open_, low, tried = open_.join(again, _IDS, "left_semi"), high + 1, 2 * tried
    return functools.reduce(DataFrame.unionByName, (p for p, _ in parts)), functools.reduce(DataFrame.unionByName, (e for _, e in parts))


def _numbered_alone(rows: DataFrame) -> DataFrame:
    """Alignments of a transcript that no other one of it covers."""
    shown = rows.select(*_IDS, "fact_no", F.transform("exons", lambda e: F.struct(e["gen_start"].alias("gen_start"), e["gen_end"].alias("gen_end"))).alias("exons"))
    return rows.join(refine.without_contained_alignments(shown, _IDS).select(*_IDS, "fact_no"), [*_IDS, "fact_no"], "left_semi")


def aligned(transcripts: DataFrame, genome: DataFrame, config: Config = Config()) -> DataFrame:
    """(locus, est_id, fact_no, exons, est, genome): all alignments of each transcript
    (locus, est_id, seq) on its locus (locus, seq), refined. Exons are 1-based."""
    masked = transcripts.select(*_IDS, F.upper("seq").alias("est"), align.masked(F.upper("seq"))["seq"].alias("seq")).withColumn("length", F.length("est"))
    texts = masked.select(*_IDS, F.col("seq").alias("masked"), "est", "length").join(genome.select("locus", F.col("seq").alias("genome")), "locus")
    found = seeds.seed_matches(masked.select(*_IDS, "seq"), genome.select("locus", F.col("locus").alias("gen_id"), "seq"), ["locus"], config.min_factor_length, rate=config.min_string_depth_rate)
    pairings, linked = graph(cut_lineage(found.drop("gen_id").join(masked.select(*_IDS, "length"), _IDS)), config)
    ends = seeds.ends(pairings, linked, _IDS, config.max_discarded_rate)
    linked = paths.with_cuts(linked, genome, ["locus"], config.min_factor_length)
    chained = paths.maximal_paths(pairings, linked, _IDS, ends, config.min_factor_length, config.min_intron_length)
    rows = chained.select(*_IDS, F.col("path_no").alias("fact_no"), paths.path_exons(F.col("path"), config.min_factor_length).alias("exons"))
    monotone = F.forall(F.sequence(F.lit(1), F.size("exons")), lambda i: (F.element_at("exons", i)["gen_start"] <= F.element_at("exons", i)["gen_end"]) & ((i == 1) | (F.try_element_at("exons", i - 1)["gen_end"] < F.element_at("exons", i)["gen_start"])))
    rows = cut_lineage(rows.filter((F.size("exons") > 0) & monotone).join(texts, _IDS))

    # what a path's exons must be like (P05-P08), and which paths stay
    rows = cut_lineage(paths.trimmed(rows, "masked"))
    rows = refine.without_bad_ends(rows, "masked")
    rows = refine.without_noisy(refine.without_low_complexity(rows, "masked"), "masked")
    covered = (F.element_at("exons", -1)["est_end"] - F.element_at("exons", 1)["est_start"] + 1) / F.col("length")
    rows = cut_lineage(rows.withColumn("coverage", covered).filter(F.col("coverage") >= config.min_coverage))
    rows = _numbered_alone(rows)
    rows = chains.coverage_filter(rows.withColumn("_key", F.struct(*_IDS)), "_key", least=config.min_coverage, apart=config.max_difference_of_coverage)
    gap = F.aggregate(F.sequence(F.lit(1), F.size("exons")), F.lit(0).cast("bigint"), lambda a, i: a + F.when(i > 1, F.element_at("exons", i)["est_start"] - F.try_element_at("exons", F.when(i > 1, i - 1))["est_end"] - 1).otherwise(0))
    rows = chains.gap_filter(rows.withColumn("gap", gap), "_key")
    rows = cut_lineage(chains.cap_alignments(rows, "_key", config.max_no_of_factorizations).drop("_key", "gap", "coverage", "length"))
    rows = paths.filled(rows, [*_IDS, "fact_no"], "masked")

    # sites and small exons (P12-P17), then the unmasked transcript
    rows = cut_lineage(splices.refine(cut_lineage(rows), "masked", min_intron=config.min_intron_length))
    rows = small_exons.without_false(_numbered_alone(rows), [*_IDS, "fact_no"], "masked")
    rows = small_exons.with_hidden(_numbered_alone(rows), [*_IDS, "fact_no"], "masked", min_intron=config.min_intron_length)
    rows = refine.without_bad_ends(refine.without_noisy(rows))
    rows = cut_lineage(rows.drop("masked").filter(F.forall("exons", lambda e: e["gen_end"] - e["gen_start"] >= 2)))
    return _numbered_alone(rows)


def alignments(transcripts: DataFrame, genome: DataFrame, config: Config = Config()) -> DataFrame:
    """(locus, est_id, fact_no, turned, ord, est_start, est_end, gen_start, gen_end), 1-based:
    the exons of each alignment. A transcript whose strand isn't fixed (column
    ``fixed_strand``, if there is one) and that has none is tried again ``turned`` round."""
    first = cut_lineage(aligned(transcripts, genome, config)).withColumn("turned", F.lit(False))
    if "fixed_strand" in transcripts.columns:
        rest = transcripts.filter(~F.col("fixed_strand")).join(first.select(*_IDS).distinct(), _IDS, "left_anti").withColumn("seq", reverse_complement("seq"))
        first = first.unionByName(aligned(cut_lineage(rest), genome, config).withColumn("turned", F.lit(True)))
    return first.select(*_IDS, "fact_no", "turned", F.posexplode("exons").alias("ord", "e")).select(*_IDS, "fact_no", "turned", (F.col("ord") + 1).alias("ord"), "e.*")


def read_junctions(exons: DataFrame) -> DataFrame:
    """Each junction of each alignment: i_start, i_end, and the exons beside it as
    ``donor`` and ``acceptor``."""
    exon = F.struct("est_start", "est_end", "gen_start", "gen_end")
    after = F.lead(exon).over(Window.partitionBy(*_IDS, "fact_no").orderBy("ord"))
    rows = exons.select(*_IDS, "fact_no", "turned", "ord", exon.alias("donor"), after.alias("acceptor")).filter("acceptor IS NOT NULL")
    return rows.withColumn("i_start", F.col("donor.gen_end") + 1).withColumn("i_end", F.col("acceptor.gen_start") - 1)


def agreed(junctions: DataFrame, transcripts: DataFrame, genome: DataFrame, kind: Column | None = None) -> DataFrame:
    """Junctions moved to better introns near them: canonical ones to RefSeq's, then to
    more frequent canonical ones, others to any of these and then to more frequent others
    (J06-J08, J10). Passes run in this order on what the last one left; a read moves to the
    first target that its own bases allow (J12). ``kind`` classifies an intron by its column
    ``pattern`` (ND: not at all); without it, known patterns count."""
    keys, place = ["locus"], ["locus", "i_start", "i_end"]
    texts = transcripts.select(*_IDS, F.upper("seq").alias("est")).join(genome.select("locus", F.col("seq").alias("genome")), "locus")
    cut = lambda at: F.substring("genome", at.cast("int"), F.lit(2))
    seen = junctions.groupBy(*place).agg(F.bool_or(fasta.is_refseq("est_id")).alias("refseq")).join(genome.select("locus", F.col("seq").alias("genome")), "locus")
    seen = seen.withColumn("pattern", F.upper(F.concat(cut(F.col("i_start")), cut(F.col("i_end") - 1))))
    known = kind if kind is not None else F.when(F.col("pattern").isin("GTAG", "GCAG", "ATAC"), "U2").otherwise("ND")
    frequency = pattern_frequency(F.substring("pattern", 1, 2), F.substring("pattern", 3, 2))
    meta = cut_lineage(seen.select(*place, consensus.agree_type(F.col("refseq"), F.col("pattern"), known).alias("agree_type"), frequency.alias("frequency")))
    order = consensus.targets_in_order
    steps = (lambda x: consensus.agree_with_reference(x, keys, choose=order), lambda x: consensus.agree_with_better(x, keys, 1, choose=order), lambda x: consensus.agree_with_any(x, keys, choose=order), lambda x: consensus.agree_with_better(x, keys, 2, choose=order))
    for step in steps:
        support = junctions.groupBy(*place).agg(F.count("*").alias("support"))
        pairs = step(meta.join(support, place, "left").fillna(0, ["support"])).filter("support > 0").select(*place, "t_start", "t_end", "rank", "agree_type")
        tried = junctions.join(pairs, place).join(texts, _IDS).withColumn("est", F.when(F.col("turned"), reverse_complement("est")).otherwise(F.col("est")))
        tried = repair.within_limits(tried)
        best = tried.groupBy(*_IDS, "fact_no", "ord").agg(F.min(F.struct("rank", "t_start", "t_end")).alias("_t"))
        both = junctions.join(best, [*_IDS, "fact_no", "ord"], "left")
        left, right = F.coalesce(F.col("_t.t_start") - F.col("i_start"), F.lit(0)), F.coalesce(F.col("_t.t_end") - F.col("i_end"), F.lit(0))
        moved = both.withColumns({"donor": F.col("donor").withField("gen_end", F.col("donor.gen_end") + left), "acceptor": F.col("acceptor").withField("gen_start", F.col("acceptor.gen_start") + right), "i_start": F.col("i_start") + left, "i_end": F.col("i_end") + right})
        junctions = cut_lineage(moved.drop("_t"))
    return junctions


def alignment_introns(junctions: DataFrame) -> DataFrame:
    """(locus, tid, ord, i_start, i_end): the introns of all junctions, each once for a
    transcript."""
    return junctions.select("locus", F.col("est_id").alias("tid"), "ord", "i_start", "i_end").dropDuplicates(["locus", "tid", "i_start", "i_end"])


def introns(spark: SparkSession, genome_path: str, transcript_path: str, config: Config = Config()) -> DataFrame:
    """The intron report of all loci (K03), with patterns and contexts. A transcript's
    locus is the record whose name is in its /locus= field, or the only one."""
    genome = loci(spark, genome_path)
    records = fasta.transcripts(fasta.read(spark, transcript_path)).filter("reason IS NULL")
    named = F.nullif(F.regexp_extract("est_id", "/locus=([^ /]+)", 1), F.lit(""))
    only = genome.agg(F.min("locus").alias("only"))
    rows = records.crossJoin(F.broadcast(only)).select(F.coalesce(named, "only").alias("locus"), F.col("gb").alias("est_id"), "fixed_strand", "seq")
    junctions = cut_lineage(read_junctions(alignments(rows, genome, config)))
    found = alignment_introns(agreed(junctions, rows, genome))
    table = report.intron_table(found, ["locus"], F.lit(1), F.lit(1), F.lit(1))
    with_genome = table.drop("abs_start", "abs_end").join(genome, "locus")
    context = flanks("seq", "i_start", "i_end")
    at_plus, at_minus = F.col("abs_start") + F.col("i_start") - 1, F.col("abs_end") - F.col("i_end") + 1
    start = F.when(F.col("strand") >= 0, at_plus).otherwise(at_minus)
    return with_genome.select("locus", "i_start", "i_end", start.alias("abs_left"), (start + F.col("length") - 1).alias("abs_right"), "length", "support", "supporting", context.alias("c")).select("*", "c.*").drop("c")


def consensus_introns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Introns with support after agreement: canonical ones to RefSeq, others to RefSeq
    or canonical, then to more frequent ones of their type. Types, frequencies and
    support are columns; passes run in this order on what the last one left."""
    now = rows
    steps = (lambda x: consensus.agree_with_reference(x, keys), lambda x: consensus.agree_with_better(x, keys, 1), lambda x: consensus.agree_with_any(x, keys), lambda x: consensus.agree_with_better(x, keys, 2))
    for step in steps:
        support = consensus.after_agreement(now, step(now), keys)
        now = support.join(rows.select(*keys, "i_start", "i_end", "agree_type", "frequency"), [*keys, "i_start", "i_end"])
    return now


def full_length(chain: DataFrame, keys: list[str]) -> DataFrame:
    """Chains that no other one contains, with their outer exons reduced."""
    return isoforms.without_contained(chains.reduce_outer_exons(chain, keys), keys)
