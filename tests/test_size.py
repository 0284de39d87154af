"""What keeps queries within their limits on large tables: plans without a call for each
group, nothing written or compared more often than it must be, no bounds on results."""

import inspect
import random

import pytest

from splicework.operators import cover, graphs, isoforms, refine, seeds
from splicework.plans import pipeline


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_covers_are_searched_in_batches(spark):
    rng = random.Random(5)
    rows = sorted({(k, t, a, rng.choice("abcdefg")) for k in range(300) for t in range(4) for a in range(2) for _ in range(3)})
    found = cover.minimum_cover(spark.createDataFrame(rows, "k int, tid int, alt int, window string"), ["k"])
    assert "FlatMapGroups" not in plan(found)
    got = {}
    for r in found.collect():
        got.setdefault(r["k"], []).append(r["window"])
    for k in range(300):
        ways = {}
        for _, t, a, w in (r for r in rows if r[0] == k):
            ways.setdefault(t, {}).setdefault(a, set()).add(w)
        fits = [c for c in range(128) if all(any(all(c >> ord(w) - 97 & 1 for w in x) for x in o.values()) for o in ways.values())]
        # the least one, of equals the first in order
        best = min(fits, key=lambda c: (c.bit_count(), [i for i in range(7) if c >> i & 1]))
        assert sorted(got[k]) == ["abcdefg"[i] for i in range(7) if best >> i & 1]


def test_paths_have_no_bound(spark):
    assert list(inspect.signature(graphs.paths).parameters) == ["edge_rows", "keys"]
    # six diamonds in a row have 64 paths, and an edge of its own one
    edges = [(1, 3 * i, 3 * i + k) for i in range(6) for k in (1, 2)] + [(1, 3 * i + k, 3 * i + 3) for i in range(6) for k in (1, 2)] + [(2, 5, 7)]
    frame = spark.createDataFrame(edges, "k int, src bigint, dst bigint")
    got = sorted((r["k"], tuple(r["path"])) for r in graphs.paths(frame, ["k"]).collect())
    want = {(0,)}
    for i in range(6):
        want = {(*p, 3 * i + k, 3 * i + 3) for p in want for k in (1, 2)}
    assert got == sorted([(1, p) for p in want] + [(2, (5, 7))])
    assert graphs.paths(frame.limit(0), ["k"]).collect() == []


def copies(spark):
    """Two chains of many copies, and one that the second extends; 9 lies in the first."""
    of = {1: [(10, 20), (40, 50), (70, 80)], 2: [(42, 50), (70, 80), (100, 120)], 9: [(12, 20), (40, 48)]}
    rows = [(7, tid, i + 1, s, e) for tid in range(1, 30) for i, (s, e) in enumerate(of[9] if tid == 9 else of[1 + tid % 2])]
    return spark.createDataFrame(rows, "locus int, tid int, ord int, gen_start int, gen_end int")


def test_equal_chains_are_compared_once(spark):
    one, members = isoforms.shapes(isoforms.exon_arrays(copies(spark), ["locus"]), ["locus"])
    assert sorted(r["tid"] for r in one.collect()) == [1, 2, 9]
    assert sorted((r["shape"], r["tid"]) for r in members.collect()) == sorted((9 if t == 9 else 1 if t % 2 else 2, t) for t in range(1, 30))
    got = {(r["tid1"], r["tid2"], r["at"], r["relation"]) for r in isoforms.chain_pairs(copies(spark), ["locus"]).collect()}
    want = {(a, b, 0, "included") for a in range(1, 30) for b in range(1, 30) if a != b and a != 9 and b != 9 and a % 2 == b % 2}
    want |= {(a, b, 1, "extends") for a in range(1, 30, 2) if a != 9 for b in range(2, 30, 2)} | {(9, b, 0, "included") for b in range(2, 30, 2)}
    assert got == want


def test_contained_copies_are_compared_once(spark):
    left = isoforms.without_contained(copies(spark), ["locus"])
    # the different chains, written once
    assert "Scan parquet" in plan(left)
    assert sorted(r["tid"] for r in left.collect()) == [1, 2]


@pytest.mark.parametrize("letters", ["ACGT", "A*", "AC#N", "ab\u00e9\U0001f600"])
def test_matches_of_two_texts(monkeypatch, letters):
    monkeypatch.setattr(seeds, "HITS", 5)
    rng = random.Random(letters)
    for _ in range(40):
        k = rng.randint(1, 4)
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in "ab")
        fine = lambda p, t, l: a[p : p + l] == b[t : t + l] and len(a[p : p + l]) == l and not set(a[p : p + l]) & set("*#")  # noqa: B023, E731
        want = set()
        for p in range(len(a)):
            for t in range(len(b)):
                if not (p and t and fine(p - 1, t - 1, 1)):
                    l = max((x for x in range(len(a) + 1) if fine(p, t, x)), default=0)
                    want |= {(p, t, l)} if l >= k else set()
        got = list(zip(*seeds.exact_matches(a, b, k).tolist(), strict=True))
        assert sorted(got) == sorted(want)


def test_seeds_shuffle_texts_only(spark):
    text = "ACGTACGTTTACG"
    frame = lambda c: spark.createDataFrame([(1, 5, text), (2, 6, None)], f"g int, {c} int, seq string")
    found = seeds.seed_matches(frame("est_id"), frame("gen_id"), ["g"], 4)
    assert "kmer" not in plan(found)
    assert (0, 0, len(text)) in {(r["p"], r["t"], r["l"]) for r in found.collect()}


def test_transcripts_are_solved_in_batches(spark):
    rows = [(t, no, [(10 + no, 20), (40, 50 - no)]) for t in range(50) for no in range(3)] + [(50, 0, [(1, 5)]), (50, 1, [(1, 9)])]
    frame = spark.createDataFrame(rows, "est int, fact_no int, exons array<struct<gen_start: int, gen_end: int>>")
    kept = refine.without_contained_alignments(frame, ["est"])
    assert "FlatMapGroups" not in plan(kept)
    got = {r["est"]: (r["fact_no"], [tuple(e) for e in r["exons"]]) for r in kept.collect()}
    assert got == {t: (0, [(10, 20), (40, 50)]) for t in range(50)} | {50: (1, [(1, 9)])}


def test_rounds_double_the_seeds_tried(spark, monkeypatch):
    # too complex until seeds are longer than its pairings, and one that isn't
    rows = [(1, "a", 60, 3 * i, 3 * i, 25) for i in range(15)] + [(1, "b", 60, 0, 0, 20), (1, "b", 60, 22, 22, 12)]
    frame = spark.createDataFrame(rows, "locus int, est_id string, length int, p int, t int, l int")
    counted, rounds = graphs.statistics, []
    monkeypatch.setattr(graphs, "statistics", lambda *x: rounds.append(1) or counted(*x))
    kept, linked = pipeline.graph(frame, pipeline.Config(min_factor_length=10))
    assert len(rounds) <= 5
    assert sorted((r["est_id"], r["p"]) for r in kept.collect()) == [("b", 0), ("b", 22)]
    assert [(r["est_id"], r["p1"], r["p2"]) for r in linked.collect()] == [("b", 0, 22)]
