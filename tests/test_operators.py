"""Operators against brute force on small inputs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from splicework.functions import sequence as S
from splicework.operators import align, chains, cover, graphs, intervals, isoforms, seeds
from splicework.sources import fasta


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("seq", "want"), [("ACGTN", "NACGT"), ("acgtRYMKBVDH", "DHBVMKRYacgt"), ("", "")])
def test_reverse_complement(spark, seq, want):
    assert one(spark, S.reverse_complement(F.lit(seq))) == want


@pytest.mark.parametrize(("seq", "want"), [("AAAAAAAAAA", 4.5), ("ACGTACGTAC", 0.75), ("AC", 0.0), ("", 0.0), ("aaaaaaaaaa", 4.5)])
def test_dust(spark, seq, want):
    assert one(spark, S.dust_score(F.lit(seq))) == pytest.approx(want)


def test_pattern_frequency(spark):
    frame = spark.createDataFrame([(p, n) for p, n in S.FREQUENCIES.items()] + [("AAAA", 0), ("", 0), ("gtag", 200)], "p string, n int")
    assert frame.filter(S.pattern_frequency(F.substring("p", 1, 2), F.substring("p", 3, 2)) != F.col("n")).count() == 0
    assert len(S.FREQUENCIES) == 58


def test_lift_both_strands(spark):
    at = lambda strand, a, b: tuple(one(spark, S.lift(F.lit(strand), F.lit(1000), F.lit(1999), F.lit(a), F.lit(b))))
    assert at(1, 1, 1000) == (1000, 1999)
    assert at(-1, 1, 10) == (1990, 1999)


def test_headers(spark):
    rows = spark.createDataFrame([("/gb=AA1.0 /clone_end=5'",), ("/gb=NM_1/clone_end=5'",), ("plain",)], "h string")
    got = rows.select(fasta.accession("h"), fasta.strand("h")).collect()
    assert [tuple(r) for r in got] == [("AA1.0", -1), ("NM_1", 1), (None, 1)]
    assert tuple(one(spark, fasta.locus_header(F.lit("chr1:5:9:-1"), F.lit(5)))) == ("chr1", 5, 9, -1)
    assert tuple(one(spark, fasta.locus_header(F.lit("chr1:x"), F.lit(5)))) == ("unknown", 1, 5, 1)


def test_fasta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a /gb=x", "ACGT"), ("b", "")], "header string, seq string")
    fasta.write(rows, str(tmp_path / "f"))
    assert sorted(tuple(r) for r in fasta.read(spark, str(tmp_path / "f")).collect()) == [("a /gb=x", "ACGT"), ("b", "")]


def test_interval_union(spark):
    rng = random.Random(1)
    rows = [(k, s := rng.randint(1, 60), s + rng.randint(0, 6)) for k in range(5) for _ in range(12)]
    want = set()
    for k in range(5):
        own = sorted(r[1:] for r in rows if r[0] == k)
        out = []
        for s, e in own:
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        want |= {(k, s, e) for s, e in out}
    got = intervals.union(spark.createDataFrame(rows, "k int, start int, end int"), ["k"]).select("k", "start", "end").collect()
    assert {tuple(r) for r in got} == want


def maximal(a, b, k):
    out = set()
    for p in range(len(a)):
        for t in range(len(b)):
            if a[p] != b[t] or (p and t and a[p - 1] == b[t - 1]):
                continue
            n = 0
            while p + n < len(a) and t + n < len(b) and a[p + n] == b[t + n]:
                n += 1
            if n >= k:
                out.add((p, t, n))
    return out


def test_seed_matches(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choices("ACG", k=25)), "".join(rng.choices("ACG", k=30))) for _ in range(20)]
    est = spark.createDataFrame([(i, i, a) for i, (a, _) in enumerate(pairs)], "g int, est_id int, seq string")
    gen = spark.createDataFrame([(i, i, b) for i, (_, b) in enumerate(pairs)], "g int, gen_id int, seq string")
    got = {}
    for r in seeds.seed_matches(est, gen, ["g"], 4).collect():
        got.setdefault(r["g"], set()).add((r["p"], r["t"], r["l"]))
    assert all(got.get(i, set()) == maximal(a, b, 4) for i, (a, b) in enumerate(pairs))


def test_minimum_cover(spark):
    rng = random.Random(3)
    rows = sorted({(k, t, a, rng.randint(0, 6)) for k in range(15) for t in range(3) for a in range(2) for _ in range(3)})
    got = {}
    for r in cover.minimum_cover(spark.createDataFrame(rows, "k int, tid int, alt int, window int"), ["k"]).collect():
        got.setdefault(r["k"], set()).add(r["window"])
    for k in range(15):
        options = {}
        for _, t, a, w in (r for r in rows if r[0] == k):
            options.setdefault(t, {}).setdefault(a, set()).add(w)
        fits = lambda s: all(any(x <= s for x in o.values()) for o in options.values())  # noqa: B023, E731
        least = next(n for n in range(1, 8) if any(fits(set(c)) for c in combinations(range(7), n)))
        assert fits(got[k])
        assert len(got[k]) == least


def test_graph_paths_and_dangling(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (1, 2, 3), (1, 4, 5)], "k int, src int, dst int")
    assert sorted(r["path"] for r in graphs.paths(edges, ["k"]).collect()) == [[0, 1, 2, 3], [0, 2, 3], [4, 5]]
    node = lambda n: spark.createDataFrame([(1, n)], "k int, node int")
    left = graphs.without_dangling(edges, ["k"], node(0), node(3)).collect()
    assert {(r["src"], r["dst"]) for r in left} == {(0, 1), (1, 2), (0, 2), (2, 3)}
    reduced = graphs.transitive_reduction(edges, ["k"]).collect()
    assert {(r["src"], r["dst"]) for r in reduced} == {(0, 1), (1, 2), (2, 3), (4, 5)}


def test_chain_pairs_and_merge(spark):
    rows = [(1, 1, 1, 10, 20), (1, 1, 2, 40, 50), (1, 1, 3, 70, 80), (1, 2, 1, 42, 50), (1, 2, 2, 70, 80), (1, 2, 3, 100, 120), (1, 3, 1, 12, 20), (1, 3, 2, 40, 48)]
    chain = spark.createDataFrame(rows, "locus int, tid int, ord int, gen_start int, gen_end int")
    pairs = isoforms.chain_pairs(chain, ["locus"])
    assert {(r["tid1"], r["tid2"], r["relation"]) for r in pairs.collect()} == {(2, 1, "extends"), (3, 1, "included")}
    merged = isoforms.merged_chains(pairs, isoforms.exon_arrays(chain, ["locus"]), ["locus"]).first()
    assert [tuple(e) for e in merged["exons"]] == [(10, 20), (40, 50), (70, 80), (100, 120)]
    assert {r["tid"] for r in isoforms.without_contained(chain, ["locus"]).collect()} == {1, 2}


def test_end_matching(spark):
    match = lambda *x: one(spark, isoforms.left_match(*map(F.lit, x)))
    assert match(1, 1, 100, 200, 102, 198)
    assert not match(1, 1, 100, 200, 103, 200)
    assert match(-1, 1, 150, 200, 120, 201)
    assert one(spark, isoforms.right_match(*map(F.lit, (1, 1, 100, 200, 100, 220, True))))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y and "N" not in (x, y)))
    return row[-1]


def test_alignments():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ("".join(rng.choices("ACGTN", k=rng.randint(0, 12))) for _ in range(2))
        x, y, n = align.global_alignment(a, b)
        assert (x.replace("-", ""), y.replace("-", "")) == (a, b)
        assert n == edits(a, b) == sum(p != q and ("-" in (p, q) or "N" not in (p, q)) for p, q in zip(x, y, strict=True))


def test_gap_alignment():
    left, right = "ACGTACGTTGCAACGTAGCTAGGATCCATG", "TTGACCAGTACCGATTGCAAGGCTAACGTT"
    gen = left + "GT" + "C" * 60 + "AG" + right
    score, cut, start, end = align.gap_alignment(left + right, gen)
    assert (score, cut, end - start + 1) == (60, start - 1, 64)
    assert gen[:cut] + gen[end:] == left + right
    assert align.gap_alignment("", "ACGT")[0] == 0


def test_tail_mask():
    assert align.tail_mask("CG" * 8 + "A" * 20) == ("CG" * 8 + "*" * 20, -1, 20)
    assert align.tail_mask("T" * 20 + "CG" * 8)[1] == 20
    assert align.tail_mask("") == ("", -1, -1)


def test_common_factor_and_border():
    assert align.longest_common_factor("XXACGTYY", "ZACGTZZ") == (2, 1, 4)
    gen = "ACGTTGCA" + "GT" + "CCCCCCCCCC" + "AG" + "TTGACCAG"
    assert align.border_split("ACGTTGCATTGACCAG", gen, 2, lambda k: {"GTAG": 200}.get(k, 0)) == (0, 8, 8, 8)


def test_empty_chain(spark):
    none = spark.createDataFrame([], "locus int, tid int, ord int, gen_start int, gen_end int")
    assert chains.intron_support(chains.introns(none), ["locus"]).count() == 0
    assert chains.composition_key(none, ["locus"]).count() == 0


def test_factorization_round_trip(spark, tmp_path):
    from splicework.sources import records

    text = ">a\n#polya=1\n#polyad=0\n1 10 101 110 ACGT ACGA\n11 20 201 210 A C\n>a\n#polya=0\n#polyad=0\n1 9 5 13 A A\n>b\n#polya=0\n#polyad=1\n2 9 5 12 A A\n"
    (tmp_path / "f.txt").write_text(text)
    rows = records.read_factorizations(spark, str(tmp_path / "f.txt"))
    got = {(r["est_id"], r["fact_no"]): r for r in rows.collect()}
    assert [tuple(e) for e in got["a", 1]["exons"]] == [(1, 10, 101, 110, "ACGT", "ACGA"), (11, 20, 201, 210, "A", "C")]
    assert (got["a", 1]["polya"], got["b", 1]["polyad"], len(got)) == (True, True, 3)
    records.write_factorizations(rows, str(tmp_path / "out"))
    again = {(r["est_id"], r["fact_no"]): r for r in records.read_factorizations(spark, str(tmp_path / "out")).collect()}
    assert again == got
    inner = {r["est_id"]: r["value"] for r in records.factorization_text(rows.filter("fact_no = 1"), externals=False).collect()}
    assert "11 20 201 210" in inner["a"]
    assert "1 10 101 110" not in inner["a"]


def test_relaxed_containment(spark):
    from splicework.operators import refine

    rows = [(1, 1, [(100, 200), (300, 400), (500, 600)]), (1, 2, [(310, 420), (520, 590)]), (1, 3, [(90, 205), (300, 400), (505, 640)]), (1, 4, [(2000, 2100)]), (1, 5, [(2010, 2050)]), (1, 6, [(1990, 2200)])]
    frame = spark.createDataFrame(rows, "est int, fact_no int, exons array<struct<gen_start:int,gen_end:int>>")
    got = {r["fact_no"]: [tuple(e) for e in r["exons"]] for r in refine.without_contained_alignments(frame, ["est"]).collect()}
    assert got == {1: [(90, 200), (300, 400), (500, 640)], 6: [(1990, 2200)]}
