"""The gene pipeline on a made-up locus, and streaming support."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from splicework.operators.chains import introns as chain_introns
from splicework.plans import pipeline
from splicework.streaming import support

RNG = random.Random(9)


def bases(n):
    return "".join(RNG.choices("ACGT", k=n))


@pytest.fixture(scope="module")
def locus():
    exons = [bases(120), bases(90), bases(150)]
    gaps = ["GT" + bases(200) + "AG", "GT" + bases(300) + "AG"]
    return exons, exons[0] + gaps[0] + exons[1] + gaps[1] + exons[2], [(121, 324), (415, 718)]


@pytest.mark.parametrize("strand", [1, -1])
def test_introns_from_fasta(spark, locus, tmp_path, strand):
    exons, genome, gaps = locus
    (tmp_path / "g.fa").write_text(f">chr1:1001:{1000 + len(genome)}:{strand}\n" + "\n".join(genome[i : i + 70] for i in range(0, len(genome), 70)) + "\n")
    whole = "".join(exons)
    back = whole[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = {"A1": (whole[10:330], "3"), "A2": (back, "5"), "A3": (exons[0][20:] + exons[1] + "A" * 25, "3"), "A4": (exons[2], "3")}
    (tmp_path / "e.fa").write_text("".join(f">x /gb={k} /clone_end={e}'\n{s}\n" for k, (s, e) in reads.items()))
    got = {(r["i_start"], r["i_end"]): r for r in pipeline.introns(spark, str(tmp_path / "g.fa"), str(tmp_path / "e.fa")).collect()}
    assert set(got) == set(gaps)
    assert got[gaps[0]]["supporting"] == "A1,A2,A3"
    assert got[gaps[1]]["supporting"] == "A1,A2"
    assert all(r["pattern"] == "GTAG" for r in got.values())
    left = gaps[0][0] + 1000 if strand > 0 else 1000 + len(genome) - gaps[0][1] + 1
    assert got[gaps[0]]["abs_left"] == left


def test_config():
    with pytest.raises(ValueError):
        pipeline.Config(min_factor_length=2)
    with pytest.raises(ValueError):
        pipeline.Config(min_coverage=2)


def test_streaming_support(spark, tmp_path):
    rows = [(1, t, o, s, s + 9) for t in range(6) for o, s in enumerate((1, 60, 120))]
    chain = spark.createDataFrame(rows, "locus int, tid int, ord int, gen_start int, gen_end int")
    gaps = chain_introns(chain).select("locus", "i_start", "i_end")
    gaps.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(gaps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = support.running_support(stream, ["locus"]).writeStream.outputMode("complete").format("memory").queryName("support").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("support").collect()} == {(1, 11, 59, 6), (1, 70, 119, 6)}


def test_consensus_passes(spark):
    rows = [(1, 100, 200, 0, 200, 5), (1, 105, 195, 1, 126, 2), (1, 300, 400, 1, 200, 3), (1, 303, 402, 2, 1, 1)]
    frame = spark.createDataFrame(rows, "locus int, i_start int, i_end int, agree_type int, frequency int, support long")
    got = {(r["i_start"], r["i_end"]): r["support"] for r in pipeline.consensus_introns(frame, ["locus"]).select("i_start", "i_end", F.col("support")).collect()}
    assert got == {(100, 200): 7, (300, 400): 4}


def test_noisy_reads(spark, tmp_path):
    """A small exon, mismatches beside junctions, reads of either strand, a read that
    isn't of the locus, and one with too little of it."""
    rng = random.Random(77)
    base = lambda n: "".join(rng.choices("ACGT", k=n))
    inner = lambda n: base(n).replace("AG", "AC").replace("GT", "CT").replace("GC", "CC")
    exons = [base(140), base(11), base(120), base(160)]
    gaps = ["GT" + inner(n) + "AG" for n in (180, 150, 260)]
    genome = base(60) + "".join(e + g for e, g in zip(exons, [*gaps, ""], strict=True)) + base(60)
    at, true = 60, []
    for e, g in zip(exons, gaps, strict=False):
        at += len(e)
        true.append((at + 1, at + len(g)))
        at += len(g)
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    swap = lambda s, k: s[:k] + ("A" if s[k] != "A" else "C") + s[k + 1 :]
    whole = "".join(exons)
    reads = {
        "B1": whole,
        "B2": swap(swap(whole, 100), 300),
        "B3": back(whole[20:]),  # the wrong way round, by its name
        "B4": swap(exons[2] + exons[3], 130),  # ten bases into the last exon
        "B5": base(300),
        "B6": exons[3][:60] + base(300),
    }
    (tmp_path / "g.fa").write_text(f">chr2:501:{500 + len(genome)}:1\n{genome}\n")
    (tmp_path / "e.fa").write_text("".join(f">x /gb={k} /clone_end=3'\n{s}\n" for k, s in reads.items()))
    config = pipeline.Config()
    loci = pipeline.loci(spark, str(tmp_path / "g.fa"))
    got = {(r["i_start"], r["i_end"]): r for r in pipeline.introns(spark, str(tmp_path / "g.fa"), str(tmp_path / "e.fa"), config).collect()}
    assert loci.count() == 1 and set(got) == set(true)
    assert [got[t]["supporting"] for t in true] == ["B1,B2,B3", "B1,B2,B3", "B1,B2,B3,B4"]


def test_complex_graphs_get_longer_seeds(spark):
    """Only the transcript whose graph is too complex is tried again."""
    many = [("l", "busy", 400, 20 * k, 20 * k + 7 * j, 15 + j % 2) for k in range(19) for j in range(10)]
    few = [("l", "calm", 400, 60 * k, 60 * k + 100 * (k // 3), 40) for k in range(6)]
    pairings = spark.createDataFrame([*many, *few], "locus string, est_id string, length int, p int, t int, l int")
    kept, linked = pipeline.graph(pairings, pipeline.Config())
    least = {r["est_id"]: r["m"] for r in kept.groupBy("est_id").agg(F.min("l").alias("m")).collect()}
    assert least.get("calm") == 40 and least.get("busy", 99) > 15
    assert kept.filter("est_id = 'calm'").count() == 6 and linked.filter("est_id = 'calm'").count() > 0


def test_reads_agree_within_their_errors(spark):
    """A canonical junction moves to RefSeq's where the read's bases allow it, another one
    with up to four edits, and reads with more stay."""
    genome = "ACGTACGTACGTACGTACGTACGTACGAGT" + "GTGTAAGT" + "C" * 60 + "TTCAGAG" + "AGCATGCATCGATCGATTACGATCGATTAG"
    n = len(genome)
    left, right = genome[:30], genome[-30:]
    exon = lambda a, b, c, d: (a, b, c, d)
    true = (exon(1, 30, 1, 30), exon(31, 60, n - 29, n))
    shifted = (exon(1, 32, 1, 32), exon(33, 60, n - 27, n))  # GT and AG again, two bases on
    back = (left + right)[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = {
        "NM_1": (left + right, true, False),
        "same": (left + "GT" + right[2:], shifted, False),  # the read has GT for AG
        "equal": (left + genome[30:32] + right[2:], shifted, False),
        "fits": (left + right, (exon(1, 32, 1, 32), exon(33, 60, n - 27, n)), False),
        "turned": (back, (exon(1, 32, 1, 32), exon(33, 60, n - 27, n)), True),
    }
    rows = [("l", k, 1, turned, 1, a, b, a[3] + 1, b[2] - 1) for k, (_, (a, b), turned) in reads.items()]
    kind = "struct<est_start: bigint, est_end: bigint, gen_start: bigint, gen_end: bigint>"
    junctions = spark.createDataFrame(rows, f"locus string, est_id string, fact_no int, turned boolean, ord int, donor {kind}, acceptor {kind}, i_start bigint, i_end bigint")
    texts = spark.createDataFrame([("l", k, x[0]) for k, x in reads.items()], "locus string, est_id string, seq string")
    found = {r["est_id"]: (r["i_start"], r["i_end"], r["acceptor"]["gen_start"]) for r in pipeline.agreed(junctions, texts, spark.createDataFrame([("l", genome)], "locus string, seq string")).collect()}
    here, there = (31, n - 30, n - 29), (33, n - 28, n - 27)
    # what leaves the exon is the read's own GT or AG, what enters is AG
    assert found == {"NM_1": here, "same": there, "equal": there, "fits": here, "turned": here}


FIXTURES = os.environ.get("GENE_FIXTURES", "")


@pytest.mark.skipif(not FIXTURES, reason="GENE_FIXTURES names no folder")
def test_given_loci(spark):
    """Complete loci (a genome, reads and a report of introns, in a folder each): all
    introns are found, and at most one read more or less supports one."""
    for report in sorted(glob.glob(f"{FIXTURES}/*/introns.json")):
        folder = os.path.dirname(report)
        with open(report) as f:
            want = {tuple(map(int, k.split("-"))): set(v) for k, v in json.load(f).items()}
        got = {(r["i_start"], r["i_end"]): set(r["supporting"].split(",")) for r in pipeline.introns(spark, f"{folder}/genome.fa", f"{folder}/reads.fa").collect()}
        assert set(want) <= set(got)
        assert all(len(want[k] ^ got[k]) <= 1 for k in want)
