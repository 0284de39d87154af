"""Repair of alignments and annotation: errors of agreements, realignment, low complexity,
final cleaning, first filtering of isoforms, reference annotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import allowed_errors, dust_score, is_start, is_stop
from . import align

#: Edits that an agreement may cost: none for canonical introns, a few for others.
CANONICAL_LIMIT, OTHER_LIMIT = 0, 4
#: Exon bases on each side of a realigned junction, intron bases, and the spacer between.
FLANK, INSIDE, SPACER = 15, 20, 20
#: Dust score beyond which an exon is of low complexity.
DUST = 20


def first_by_id(rows: DataFrame, ident: str, *order: str) -> DataFrame:
    """The first row of each id (J03): one row of an id is all that a task sends on."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(ident).alias("_id")).agg(first.alias("_row")).select("_row.*")


def _taken(est: Column, gen: Column, n: Column, from_end: bool) -> Column:
    """The transcript's bases that stand against the last (first) ``n`` genome bases of an
    aligned exon part."""

    def bases(found: tuple, e: str, g: str, n: int) -> tuple:
        step = -1 if from_end else 1
        columns, out = list(zip(*found[:2], strict=True))[::step], []
        for x, y in columns:
            if n <= 0:
                break
            out.append(x.replace("-", ""))
            n -= y != "-"
        return ("".join(out[::step]),)

    return align._pairs_udf(align.global_alignments, align.global_alignment, "bases string", est, gen, n, finish=bases)["bases"]


def agreement_error(est: Column, genome: Column, donor: Column, acceptor: Column, t_start: Column, t_end: Column) -> Column:
    """Edits that a read's intron costs when it moves to (t_start, t_end) (J12): between the
    read's own bases that leave the exons, and the genome's that enter them. Which bases
    leave is told by aligning the exon's end, three times as long as the move and a base
    more. ``donor`` and ``acceptor`` are the exons (est_start, est_end, gen_start, gen_end)."""
    piece = lambda text, start, end: F.substring(text, start.cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int"))
    back, on = F.greatest(donor["gen_end"] + 1 - t_start, F.lit(0)), F.greatest(t_end - acceptor["gen_start"] + 1, F.lit(0))
    left = _taken(
        F.when(back > 0, piece(est, F.greatest(donor["est_end"] - 3 * back, donor["est_start"]), donor["est_end"])).otherwise(""),
        F.when(back > 0, piece(genome, F.greatest(donor["gen_end"] - 3 * back, donor["gen_start"]), donor["gen_end"])).otherwise(""),
        back.cast("int"), True,
    )
    right = _taken(
        F.when(on > 0, piece(est, acceptor["est_start"], F.least(acceptor["est_start"] + 3 * on, acceptor["est_end"]))).otherwise(""),
        F.when(on > 0, piece(genome, acceptor["gen_start"], F.least(acceptor["gen_start"] + 3 * on, acceptor["gen_end"]))).otherwise(""),
        on.cast("int"), False,
    )
    enter = F.concat(piece(genome, donor["gen_end"] + 1, t_start - 1), piece(genome, t_end + 1, acceptor["gen_start"] - 1))
    return F.levenshtein(F.concat(left, right), enter)


def with_error(moves: DataFrame, est: str = "est", genome: str = "genome") -> DataFrame:
    """Moves (the texts, donor, acceptor, t_start, t_end, agree_type) with their ``error``
    (J12) and whether their type allows it: ``agree_type`` 1 none, 2 a few. Nulls give null."""
    limit = F.when(F.col("agree_type") == 1, CANONICAL_LIMIT).otherwise(OTHER_LIMIT)
    found = F.when(F.col("t_start").isNotNull() & F.col("t_end").isNotNull(), agreement_error(F.col(est), F.col(genome), F.col("donor"), F.col("acceptor"), F.coalesce("t_start", F.lit(0)), F.coalesce("t_end", F.lit(0))))
    return moves.withColumn("error", found).withColumn("allowed", F.col("error") <= limit)


def within_limits(moves: DataFrame, est: str = "est", genome: str = "genome") -> DataFrame:
    """Moves whose error their type allows."""
    return with_error(moves, est, genome).filter("allowed").drop("allowed")


def realigned(est: Column, cut: Column, genome: Column, t_start: Column, t_end: Column) -> Column:
    """struct<score, cut, intron_start, intron_end> of a transcript around its ``cut``
    (bases before the junction) against the moved intron's flanks: 15 exon and 20 intron
    bases on both sides, with a spacer that no base matches (J13). The cut counts from 15
    bases before the old one."""
    part = lambda g, at, n: F.substring(g, at.cast("int"), F.lit(n))
    window = F.substring(est, (cut - FLANK + 1).cast("int"), F.lit(2 * FLANK))
    target = F.concat(part(genome, t_start - FLANK, FLANK + INSIDE), F.lit("x" * SPACER), part(genome, t_end - INSIDE + 1, INSIDE + FLANK))
    return align.spliced(window, target)


def low_complexity(est: Column, gen: Column) -> Column:
    """Whether an exon's transcript or genome side is of low complexity (P07); what is
    left between such exons is the best segment (W09)."""
    return (dust_score(est) > DUST) | (dust_score(gen) > DUST)


def final_clean(exons: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Last rules on the unmasked sequence (P18): alignments without an exon that has more
    edits than its length allows, and without an outer exon that fails (P08, P06).
    ``exons`` has ids, ord, est_seq, gen_seq, and pattern, that of the intron beside an
    outer exon."""
    edits = F.levenshtein("est_seq", "gen_seq")
    w = Window.partitionBy(*ids)
    outer = (F.col("ord") == F.min("ord").over(w)) | (F.col("ord") == F.max("ord").over(w))
    bad = (edits > allowed_errors(F.length("est_seq"))) | (outer & align.external_exon_fails(F.length("est_seq"), edits, F.coalesce("pattern", F.lit(""))))
    return exons.withColumn("_bad", F.max(bad.cast("int")).over(w)).filter("_bad = 0").drop("_bad")


def first_filtering(chains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chains with the same introns made one (G07): support is added up; a reference chain
    stays as it is and stands for the others, else the outer ends are the widest. ``chains``
    has keys, tid, exons (an array of s and e, two at least), support, refseq (boolean).
    Reference chains of different ends stay apart; others join the least of them."""
    introns = F.transform(F.sequence(F.lit(1), F.size("exons") - 1), lambda i: F.struct((F.element_at("exons", i)["e"] + 1).alias("s"), (F.element_at("exons", i + 1)["s"] - 1).alias("e")))
    rows = chains.filter(F.size("exons") > 1).withColumn("_introns", introns).withColumn("_s", F.element_at("exons", 1)["s"]).withColumn("_e", F.element_at("exons", -1)["e"])
    # the name of the reference chain that a row joins, if there is one
    least = F.min(F.when(F.col("refseq"), F.struct("_s", "_e"))).over(Window.partitionBy(*keys, "_introns"))
    own = F.when(F.col("refseq"), F.struct("_s", "_e")).otherwise(least)
    merged = rows.withColumn("_to", own).groupBy(*keys, "_introns", "_to").agg(F.min(F.when(F.col("refseq") | F.col("_to").isNull(), F.col("tid"))).alias("tid"), F.sum("support").alias("support"), F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.bool_or("refseq").alias("refseq"), F.count("*").alias("members"))
    start, end = F.coalesce("_to._s", "_s"), F.coalesce("_to._e", "_e")
    return merged.select(*keys, "tid", start.alias("left_end"), end.alias("right_end"), F.size("_introns").alias("n_introns"), "support", "refseq", "members")


def annotated(isoforms: DataFrame, annotation: DataFrame) -> DataFrame:
    """Isoforms with the annotation of their reference transcript, if any (J17); of several
    rows of one reference the first (refseq, rel_start) counts."""
    return isoforms.join(first_by_id(annotation, "refseq", "rel_start", "rel_end"), "refseq", "left")


def annotated_cds(seq: Column, cds: Column, least: int = 100) -> Column:
    """struct<orf_start, orf_end, least>: where an annotated coding region of whole codons
    stands in a transcript, any case (T06), and the shortest reading frame that counts
    from there on: no longer than it. Nulls where it isn't found."""
    at = F.instr(F.upper(seq), F.upper(cds))
    fine = (at > 0) & (F.length(cds) > 0) & (F.length(cds) % 3 == 0)
    return F.struct(F.when(fine, at).alias("orf_start"), F.when(fine, at + F.length(cds) - 1).alias("orf_end"), F.when(fine, F.least(F.lit(least), F.length(cds))).otherwise(least).alias("least"))


def exon_alignments(exons: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Reference exons aligned to the genome (T02): ids, est, gen and edits."""
    return exons.select(*ids, align.aligned(F.col("est_seq"), F.col("gen_seq")).alias("_a")).select(*ids, "_a.*")


def codon_warnings(cds: Column) -> Column:
    """What is odd about a coding region, as a list in text (T20); empty: nothing."""
    found = F.array(F.when(~is_start(F.substring(cds, 1, 3)), F.lit("no start codon")), F.when(~is_stop(F.substring(cds, -3, 3)), F.lit("no stop codon")), F.when(F.length(cds) % 3 != 0, F.lit("broken frame")))
    return F.array_join(F.array_compact(found), "; ")


def isoform_codons(exons: DataFrame, regions: DataFrame, keys: Sequence[str], tid: str = "tid") -> DataFrame:
    """First and last codon of each annotated coding region in its isoform's joined exons,
    and which of them isn't a start or stop codon (T20): keys, tid, first_codon, last_codon,
    warnings. ``exons`` has keys, tid, ord and seq; ``regions`` keys, tid, cds_start, cds_end
    (1-based) and annotated. Other isoforms have no warnings, and no codons."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "seq")))
    whole = exons.groupBy(*keys, tid).agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("_seq"))
    codon = lambda at: F.upper(F.substring("_seq", at.cast("int"), F.lit(3)))
    rows = whole.join(regions, [*keys, tid]).withColumns({"first_codon": F.when(F.col("annotated"), codon(F.col("cds_start"))), "last_codon": F.when(F.col("annotated"), codon(F.col("cds_end") - 2))})
    odd = F.array(F.when(F.col("annotated") & ~is_start(F.col("first_codon")), F.lit("first")), F.when(F.col("annotated") & ~is_stop(F.col("last_codon")), F.lit("last")))
    return rows.select(*keys, tid, "first_codon", "last_codon", F.array_join(F.array_compact(odd), ",").alias("warnings"))


def not_ends_only(paths: DataFrame) -> DataFrame:
    """Paths with more than one source or sink vertex (P03): ``vertices`` is an array of
    structs with ``kind`` (source, sink or null)."""
    return paths.filter(F.exists("vertices", lambda v: v["kind"].isNull()) | (F.size(F.filter("vertices", lambda v: v["kind"].isNotNull())) > 1))
