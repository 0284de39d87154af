"""Repair, annotation and structure files, on small cases worked out by hand."""

import random

from pyspark.sql import functions as F

from splicework.operators import repair
from splicework.sources import structures


EXON = "struct<est_start: bigint, est_end: bigint, gen_start: bigint, gen_end: bigint>"


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_agreement_error_by_edits(spark):
    """Reads equal to the genome: the bases that leave are the genome's own."""
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        g = "".join(rng.choices("ACGT", k=120))
        s, e, t, u, kind = 30, 80, 30 + rng.randint(-5, 5), 80 + rng.randint(-5, 5), 1 + i % 2
        rows.append((i, g[: s - 1] + g[e:], g, (1, s - 1, 1, s - 1), (s, s + 39, e + 1, 120), t, u, kind))
        old, new = set(range(1, s)) | set(range(e + 1, 121)), set(range(1, t)) | set(range(u + 1, 121))
        text = lambda part: "".join(g[k - 1] for k in sorted(part))  # noqa: B023, E731
        n = edits(text(old - new), text(new - old))
        if n <= (0 if kind == 1 else 4):
            want[i] = n
    df = spark.createDataFrame(rows, f"id int, est string, genome string, donor {EXON}, acceptor {EXON}, t_start int, t_end int, agree_type int")
    assert {r["id"]: r["error"] for r in repair.within_limits(df).collect()} == want and want


def test_agreement_error_of_the_read(spark):
    """A read's own bases leave the exons, with its mismatches, insertions and deletions."""
    genome = "ACGTTGCATGCAAGCTTACG" + "GTAAGTCCCC" * 4 + "CCATTTGCAG" + "TTGACCGATAGGCATCATTA"
    left, right = genome[:20], genome[70:]
    donor, acceptor = (1, 20, 1, 20), (21, 40, 71, 90)
    cases = {
        "equal": (left + right, 18, 70, edits("ACG", "")),
        "mismatch": (left[:18] + "T" + left[19:] + right, 18, 67, edits("ATG", "CAG")),
        "same": (left + right, 18, 70 - 3, edits("ACG", "CAG")),
        # the read lacks the last base but one: two of its bases stand against three
        "deletion": (left[:18] + left[19:] + right, 18, 67, edits("AG", "CAG")),
        "insertion": (left[:19] + "T" + left[19:] + right, 18, 67, edits("ACTG", "CAG")),
        "right": (left + "TA" + right[2:], 23, 72, edits("TA", "GT")),
        "unmoved": (left + right, 21, 70, 0),
    }
    rows = []
    for k, (est, t, u, _) in cases.items():
        shift = len(est) - 40
        rows.append((k, est, genome, (1, 20 + shift, 1, 20), (21 + shift, 40 + shift, 71, 90), t, u, 2))
    assert donor and acceptor
    df = spark.createDataFrame([*rows, ("null", "", genome, None, None, None, None, 1)], f"id string, est string, genome string, donor {EXON}, acceptor {EXON}, t_start int, t_end int, agree_type int")
    got = {r["id"]: r["error"] for r in repair.with_error(df).collect()}
    assert got == {k: x[3] for k, x in cases.items()} | {"null": None}


def test_realigned_junction(spark):
    rng = random.Random(6)
    left, intron, right = ("".join(rng.choices("ACGT", k=k)) for k in (40, 70, 40))
    left, right = left[:-1] + "T", "C" + right[1:]  # no other place fits as well
    df = spark.createDataFrame([(left + right, left + "GT" + intron + "AG" + right)], "est string, genome string").selectExpr("*", "41 AS s", "114 AS e", "40 AS cut")
    r = df.select(repair.realigned(df.est, df.cut, df.genome, df.s, df.e).alias("r")).first()["r"]
    assert (r["score"], r["cut"]) == (30, 15)


def test_final_clean(spark):
    a = "ACGTTGCAAC" * 3
    rows = [(1, 1, a, a, "GTAG"), (1, 2, a, a, "GTAG"), (2, 1, a, "T" * 30, "GTAG"), (2, 2, a, a, "GTAG"), (3, 1, a[:9], a[:9], "GTAG"), (3, 2, a, a, "GTAG"), (4, 1, a[:15], a[:15], "CCCC"), (4, 2, a, a, None)]
    df = spark.createDataFrame(rows, "id int, ord int, est_seq string, gen_seq string, pattern string")
    assert {r["id"] for r in repair.final_clean(df, ["id"]).collect()} == {1}


def test_first_filtering(spark):
    x = lambda *ends: [{"s": s, "e": e} for s, e in ends]
    rows = [(1, 1, x((1, 10), (20, 30)), 2, False), (1, 2, x((3, 10), (20, 40)), 3, False), (1, 3, x((1, 10), (25, 30)), 1, False), (2, 4, x((5, 10), (20, 30)), 1, True), (2, 5, x((1, 10), (20, 90)), 4, False)]
    df = spark.createDataFrame(rows, "k int, tid int, exons array<struct<s:int,e:int>>, support int, refseq boolean")
    got = {tuple(r)[:4] + (r["support"], r["members"]) for r in repair.first_filtering(df, ["k"]).collect()}
    assert got == {(1, 1, 1, 40, 5, 2), (1, 3, 1, 30, 1, 1), (2, 4, 5, 30, 5, 2)}


def test_annotation(spark):
    df = spark.createDataFrame([("aaATGGCATAAcc", "atggcaTAA"), ("ACGT", "GG"), ("ACGT", ""), ("ACGTACG", "CGTA")], "seq string, cds string")
    got = [tuple(r[0]) for r in df.select(repair.annotated_cds(df.seq, df.cds)).collect()]
    assert got == [(3, 11, 9), (None, None, 100), (None, None, 100), (None, None, 100)]
    warn = [r[0] for r in spark.createDataFrame([("ATGTAA",), ("CCGTAAG",)], "c string").select(repair.codon_warnings(F.col("c"))).collect()]
    assert warn == ["", "no start codon; no stop codon; broken frame"]
    lone = spark.createDataFrame([(1, [{"kind": "source"}]), (2, [{"kind": "source"}, {"kind": "sink"}]), (3, [{"kind": None}])], "id int, vertices array<struct<kind:string>>")
    assert {r["id"] for r in repair.not_ends_only(lone).collect()} == {2, 3}
    same = spark.createDataFrame([(1, "ACGT", "ACT")], "id int, est_seq string, gen_seq string")
    assert repair.exon_alignments(same, ["id"]).first()["edits"] == 1


def test_structure_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("100\n900\n1\n0\n2\n3\n800\n10:20:0\n40:60:0\n40:70:1\n.5\n0.1\nACGT\nGGG\n.2.NM_1\n0.2\nACGT\nGGGT\n#\n*\n")
    got = sorted(tuple(r)[1:5] + ([tuple(e) for e in r["exons"]],) for r in structures.read_compositions(spark, str(tmp_path / "c.txt")).collect())
    assert got == [(1, 0, 5, None, [(10, 20, False, "ACGT"), (40, 60, False, "GGG")]), (1, 1, 2, "NM_1", [(10, 20, False, "ACGT"), (40, 70, True, "GGGT")])]
    (tmp_path / "t.txt").write_text("2\n>1:2:NM_7\n110:120:10:20:0\nACG\n140:160:40:60:1\nTTT\n>2:1\n110:120:10:20:0\nACG\n")
    r = {r["isoform"]: r for r in structures.read_isoforms(spark, str(tmp_path / "t.txt")).collect()}
    assert (r[1]["n_exons"], r[1]["flags"], len(r[1]["exons"]), r[2]["flags"]) == (2, ["NM_7"], 2, [])
    assert tuple(r[1]["exons"][1]) == (140, 160, 40, 60, 1, None, None, "TTT")
    (tmp_path / "a.txt").write_text("1\n500\n>1:1:0:1:-1\n110:120:10:20:0:3:4\nACG\n")
    one = structures.read_isoforms(spark, str(tmp_path / "a.txt")).first()
    assert one["flags"] == ["0", "1", "-1"] and (one["exons"][0]["utr5"], one["exons"][0]["utr3"]) == (3, 4)
    (tmp_path / "i.txt").write_text("\t".join(["11", "50", "111", "150", "40", "2", "A1,B2,", "0.5", "0", "0.9", "0.8", "0.7", "12", "U2", "GTAG", ".", "AAA", "GT", "AG", "CCC"]) + "\n")
    i = structures.read_introns(spark, str(tmp_path / "i.txt")).first()
    assert (i["rel_start"], i["supporting"], i["repeat"], i["acceptor_prefix"]) == (11, ["A1", "B2"], None, "CCC")
    (tmp_path / "g.txt").write_text("10 20 ACGT\n30 40 GG\n")
    assert {tuple(r) for r in structures.read_reference_exons(spark, str(tmp_path / "g.txt")).collect()} == {(10, 20, "ACGT"), (30, 40, "GG")}


def test_cds_tables(spark):
    iso = spark.createDataFrame([(1, [(1, 10), (21, 40), (51, 60)]), (2, [(1, 9)])], "tid int, exons array<struct<gen_start:int,gen_end:int>>")
    orf = spark.createDataFrame([(1, 4, 33)], "tid int, orf_start int, orf_end int")
    a, b = structures.cds_tables(iso, orf)
    assert {tuple(r) for r in a.collect()} == {(1, 3, 40, 4, 33, 9), (2, 1, 9, None, None, None)}
    assert {tuple(r) for r in b.filter("tid = 1").collect()} == {(1, 1, 1, 10, 3, 0), (1, 2, 21, 40, 0, 0), (1, 3, 51, 60, 0, 7)}
