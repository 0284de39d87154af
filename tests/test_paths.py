"""Paths, trimmed ends, filled gaps, splice search and small exons, against plain versions
and hand-made cases."""

import random
from itertools import product

from pyspark.sql import functions as F

from splicework.functions.sequence import FREQUENCIES
from splicework.operators import chains, paths, small_exons, splices

LEAST, INTRON = 4, 12
EXONS = "array<struct<est_start: bigint, est_end: bigint, gen_start: bigint, gen_end: bigint>>"


def frequency(pattern):
    return FREQUENCIES.get(pattern.upper(), 0)


def bases(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def plain_extend(node, head, genome):
    """P01 by trying every cut."""
    (p1, t1, l1), (p2, t2, l2) = node, head
    on_p, on_t, span = p2 + l2 - p1, t2 + l2 - t1, 2 * LEAST
    if on_p < span or on_t < span or on_p - l1 - l2 > span or on_p - on_t > span:
        return None
    keep1, keep2 = l1, l2
    if on_p < l1 + l2 or on_t < l1 + l2:
        both = min(on_p, on_t)
        keep1, keep2 = both // 2, both - both // 2
        if keep1 > l1:
            keep1, keep2 = l1, both - l1
        elif keep2 > l2:
            keep1, keep2 = both - l2, l2
    gap_p, gap_t = p2 + l2 - keep2 - p1 - keep1 - 1, t2 + l2 - keep2 - t1 - keep1 - 1
    intron = gap_t - max(0, gap_p) >= INTRON
    if on_p < l1 + l2 and intron:
        best = -1
        for cut in range(max(p1 + LEAST, p2), min(p2 + l2 - LEAST, p1 + l1) + 1):
            a, b = t1 + cut - p1, t2 + cut - p2
            n = frequency(genome[a : a + 2] + genome[b - 2 : b]) if b >= 2 else 0
            if n >= best:
                best, keep1, keep2 = n, cut - p1, p2 + l2 - cut
    return (keep1, (p2 + l2 - keep2, t2 + l2 - keep2, keep2)) if gap_t <= span or intron else None


def graphs(rng, n):
    """Random pairings of a text, and edges between those that start later on both."""
    genome = bases(rng, 160)
    pairings = sorted({(rng.randrange(60), rng.randrange(140), rng.randint(LEAST, 14)) for _ in range(n)})
    edges = [(a, b) for a in pairings for b in pairings if b[0] > a[0] and b[1] > a[1] and rng.random() < 0.6]
    return genome, pairings, edges


def plain_paths(genome, pairings, edges):
    """All paths first, and then those that no other one contains."""
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)

    def all_from(v):
        if v not in after:
            return [(v,)]
        out = []
        for w in sorted(after[v]):
            for path in all_from(w):
                if fits := plain_extend(v, path[0], genome):
                    out.append(((*v[:2], fits[0]), fits[1], *path[1:]))
        # as every pairing keeps only what isn't contained, so does the plain version
        return [p for i, p in enumerate(out) if not any(paths.within(p, q) and (not paths.within(q, p) or j < i) for j, q in enumerate(out) if j != i)]

    entered = {b for _, b in edges}
    found = [p for v in pairings if v not in entered for p in all_from(v)]
    return [p for i, p in enumerate(found) if not any(paths.within(p, q) and (not paths.within(q, p) or j < i) for j, q in enumerate(found) if j != i)]


def test_maximal_paths(spark):
    rng = random.Random(4)
    made = {f"t{k}": graphs(rng, rng.randint(1, 14)) for k in range(40)}
    made["alone"] = (bases(rng, 50), [(3, 5, 9)], [])
    genome = spark.createDataFrame([(k, g) for k, (g, _, _) in made.items()], "locus string, seq string")
    pairings = spark.createDataFrame([(k, "e", *v) for k, (_, vs, _) in made.items() for v in vs], "locus string, est_id string, p int, t int, l int")
    edges = spark.createDataFrame([(k, "e", *a, *b) for k, (_, _, es) in made.items() for a, b in es], "locus string, est_id string, p1 int, t1 int, l1 int, p2 int, t2 int, l2 int")
    got = paths.maximal_paths(pairings, paths.with_cuts(edges, genome, ["locus"], LEAST), ["locus", "est_id"], least=LEAST, min_intron=INTRON).collect()
    for k, (g, vs, es) in made.items():
        mine = [tuple(map(tuple, r["path"])) for r in sorted((r for r in got if r["locus"] == k), key=lambda r: r["path_no"])]
        assert sorted(mine) == sorted(plain_paths(g, vs, es)), k
    assert max(len(r["path"]) for r in got) >= 3


def test_ends_decide_where_paths_stop(spark):
    pairings = spark.createDataFrame([(0, 0, 9), (9, 9, 9), (18, 60, 9)], "p int, t int, l int").withColumn("est_id", F.lit("e"))
    genome = spark.createDataFrame([("A" * 90,)], "seq string").withColumn("est_id", F.lit("e"))
    edges = spark.createDataFrame([(0, 0, 9, 9, 9, 9), (9, 9, 9, 18, 60, 9)], "p1 int, t1 int, l1 int, p2 int, t2 int, l2 int").withColumn("est_id", F.lit("e"))
    ends = spark.createDataFrame([("source", 0, 0, 9), ("sink", 9, 9, 9)], "kind string, p int, t int, l int").withColumn("est_id", F.lit("e"))
    cut = paths.with_cuts(edges, genome, ["est_id"], LEAST)
    rows = lambda ends: [[tuple(x) for x in r["path"]] for r in paths.maximal_paths(pairings, cut, ["est_id"], ends, LEAST, INTRON).collect()]
    assert rows(ends) == [[(0, 0, 9), (9, 9, 9)]]
    assert rows(None) == [[(0, 0, 9), (9, 9, 9), (18, 60, 9)]]


def test_no_explosion():
    """A ladder of 24 rungs has 2^24 paths; one side of each rung contains the other."""
    pairings, after = [], {}
    for k in range(24):
        wide, narrow = (20 * k, 20 * k, 20), (20 * k + 1, 20 * k + 1, 18)
        for v in (wide, narrow):
            pairings.append(v)
            if k < 23:
                after[v] = [((20 * k + 20, 20 * k + 20, 20), ()), ((20 * k + 21, 20 * k + 21, 18), ())]
    found = paths.frontier(pairings, after, set(pairings[-2:]), set(pairings[:2]), LEAST, INTRON)
    assert found == [tuple(pairings[::2])]


def test_path_exons(spark):
    rows = [([(0, 100, 10), (10, 115, 10), (20, 200, 5)],), ([(4, 7, 3)],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "path array<struct<p: bigint, t: bigint, l: bigint>>").select(paths.path_exons(F.col("path"), 15)).collect()]
    assert [[tuple(e) for e in x] for x in got] == [[(1, 20, 101, 125), (21, 25, 201, 205)], [(5, 7, 8, 10)], []]


def test_trimmed_columns():
    assert paths.start_cut("ACGTACGT", "ACGTACGT") == (0, 0)
    assert paths.start_cut("ACCTACGTAC", "ACGTACGTAC") == (3, 3)  # six matches after the mismatch
    assert paths.start_cut("ACGTAC", "ACGTAC") is None  # nothing follows the run
    assert paths.start_cut("A-CGTACGTAA", "ATCGTACGTAA") == (1, 2)
    assert paths.end_kept("ACGTACGTACGTACC", "ACGTACGTACGTACG") == (14, 14)
    assert paths.end_kept("ACGTACGTACGT", "ACGTACGTACGT") == (12, 12)
    # the gap behind the run is closed with the same base after it
    assert paths.end_kept("ACGTACGTACGT-A", "ACGTACGTACGTAC") == (13, 13)
    assert paths.end_kept("TTTT", "ACGG") == (0, 0)


def test_trimmed(spark):
    rng = random.Random(8)
    genome = bases(rng, 200)
    est = "T" * 3 + genome[10:40] + genome[100:130] + "".join("A" if c != "A" else "C" for c in genome[130:134])
    bad = "".join("A" if c != "A" else "C" for c in genome[50:58])
    rows = [("a", [(4, 33, 11, 40), (34, 67, 101, 134)], est), ("b", [(1, 8, 51, 58), (9, 38, 101, 130)], bad + genome[100:130]), ("c", [(1, 8, 51, 58)], bad), ("d", [], "A")]
    df = spark.createDataFrame([(i, x, e, genome) for i, x, e in rows], f"id string, exons {EXONS}, est string, genome string")
    got = {r["id"]: [tuple(e) for e in r["exons"]] for r in paths.trimmed(df).collect()}
    assert got == {"a": [(4, 33, 11, 40), (34, 63, 101, 130)], "b": [(9, 38, 101, 130)]}


def test_filled(spark):
    rng = random.Random(9)
    genome = bases(rng, 400)
    est = genome[0:40] + genome[200:240] + genome[300:340]
    # six bases between the first two exons are missing, and two exons are two apart
    rows = [("a", [(1, 37, 1, 37), (44, 80, 204, 240), (81, 120, 301, 340)], est), ("near", [(1, 20, 1, 20), (21, 40, 23, 42)], est), ("short", [(1, 20, 1, 20), (31, 40, 25, 34)], est), ("far", [(1, 20, 1, 20), (101, 120, 321, 340)], est[:20] + bases(rng, 80) + est[100:])]
    df = spark.createDataFrame([(i, x, e, genome) for i, x, e in rows], f"id string, exons {EXONS}, est string, genome string")
    got = {r["id"]: [tuple(e) for e in r["exons"]] for r in paths.filled(df, ["id"]).collect()}
    assert set(got) == {"a", "near"} and got["near"] == [(1, 40, 1, 42)]
    (a, b, c) = got["a"]
    assert (a[1], b[0], b[1]) == (a[3], a[1] + 1, 80) and (a[3], b[2]) in {(k, 160 + k + 1) for k in range(37, 44)} and c == (81, 120, 301, 340)


def spliced(rng, donor="GT", acceptor="AG", shift=0, noise=0):
    """A transcript of two exons, and an alignment whose junction is ``shift`` bases off."""
    left, inner, right = bases(rng, 60), bases(rng, 120), bases(rng, 60)
    inner = donor + inner.replace("GT", "CT").replace("AG", "AC").replace("GC", "CC") + acceptor
    genome = left + inner + right
    est = list(left + right)
    for _ in range(noise):
        k = rng.choice([*range(5, 45), *range(75, 115)])
        est[k] = "ACGT"[("ACGT".index(est[k]) + 1) % 4]
    n = 60 + shift
    exons = [(1, n, 1, n), (n + 1, 120, 60 + len(inner) + 1 + shift, len(genome))]
    return "".join(est), genome, exons, [(1, 60, 1, 60), (61, 120, 60 + len(inner) + 1, len(genome))]


def test_splice_search(spark):
    """Junctions come back to where they were cut, wherever the alignment had them."""
    rng = random.Random(12)
    rows, want = [], {}
    for k, (pattern, shift, noise) in enumerate(product([("GT", "AG"), ("GC", "AG"), ("AT", "AC")], [-6, -1, 0, 2, 7], [0, 2])):
        est, genome, exons, true = spliced(rng, *pattern, shift, noise)
        rows.append((k, exons, est, genome))
        want[k] = pattern, true
    df = spark.createDataFrame(rows, f"id int, exons {EXONS}, est string, genome string")
    got = {r["id"]: [tuple(e) for e in r["exons"]] for r in splices.refine(df).collect()}
    assert set(got) == set(want)
    for k, (pattern, true) in want.items():
        (a, b), genome = got[k], rows[k][3]
        assert a[1] + 1 == b[0] and a[:1] + b[1:2] == (1, 120)
        found = genome[a[3] : a[3] + 2] + genome[b[2] - 3 : b[2] - 1]
        assert frequency(found) >= frequency("".join(pattern)), (k, found)
        if pattern == ("GT", "AG"):
            assert (a, b) == tuple(true), k


def test_splice_rules():
    """Carried bases, one way and the other, and what is refused."""
    assert splices._in_exon("CA", "GTAGC", "GTAGC", "AG") == [(1, 1), (4, 4)]
    assert splices._in_exon("AG", "GT", "GT", "AG") == [(0, 0)]
    assert splices._in_exon("TT", "G-TAG", "GCTAG", "AG") == [(5, 4)]
    # GG of the right exon fits before GT as well, and the right exon goes on after AG
    j = splices.Junction(("ACCA", "ACCA"), ("CAGTT", "CAGTT"), "CAGGTAC", "TTTTC")
    assert splices.search(j, frequency, (-9, 20)) == (3, 3, 3, "GT")
    mirrored = splices.Junction(("TTGTC", "TTGTC"), ("ACCA", "ACCA"), "CTTTT", "CAAGGTC")
    assert splices.search(mirrored, frequency, (-9, 20))[3] == "GT"
    canonical = splices.Junction(("AC", "AC"), ("CA", "CA"), "GTAA", "TTAG")
    assert splices.search(canonical, frequency, (-9, 9)) == (0, 0, 0, "canonical")


def test_junctions_that_stay(spark):
    """Too short introns and far moves stay; a first exon without a base left goes."""
    rng = random.Random(3)
    genome = bases(rng, 400)
    rows = [("short", [(1, 40, 1, 40), (41, 80, 51, 90)], genome[0:40] + genome[50:90]), ("one", [(1, 40, 1, 40)], genome[0:40]), ("none", [], "ACGT")]
    rows.append(("attached", [(1, 3, 100, 102), (4, 43, 204, 243)], genome[200:243]))
    df = spark.createDataFrame([(i, x, e, genome) for i, x, e in rows], f"id string, exons {EXONS}, est string, genome string")
    got = {r["id"]: [tuple(e) for e in r["exons"]] for r in splices.refine(df).collect()}
    assert got["short"] == rows[0][1] and got["one"] == rows[1][1] and got["none"] == []
    assert got["attached"] == [(1, 43, 201, 243)]


def test_false_exon_goes(spark):
    """An exon that lies on another place by chance is joined with its neighbours."""
    rng = random.Random(21)
    left, right, tiny = bases(rng, 50), bases(rng, 50), "ACGTTGCAAC"
    intron = "GT" + bases(rng, 80) + "CC" + tiny + "TT" + bases(rng, 80) + "AG"
    genome = left + tiny + intron + right
    at = genome.rindex("CC" + tiny + "TT") + 3
    est = left + tiny + right
    exons = [(1, 50, 1, 50), (51, 60, at, at + 9), (61, 110, len(genome) - 49, len(genome))]
    true = [(1, 60, 1, 60), (61, 110, len(genome) - 49, len(genome))]
    long = [(1, 50, 1, 50), (51, 160, 51, 160), (161, 200, 301, 340)]
    rows = [("false", exons, est, genome), ("true", true, est, genome), ("long", long, bases(rng, 200), bases(rng, 340)), ("none", [], est, genome)]
    df = spark.createDataFrame(rows, f"id string, exons {EXONS}, est string, genome string")
    got = {r["id"]: [tuple(e) for e in r["exons"]] for r in small_exons.without_false(df, ["id"]).collect()}
    assert got == {"false": true, "true": true, "long": long, "none": []}


def hidden_exon(rng, n, donor="GT"):
    left, right, tiny = bases(rng, 50), bases(rng, 50), bases(rng, n)
    inner = lambda: bases(rng, 60).replace("AG", "AC")
    one, two = donor + inner() + "AG", "GT" + inner() + "AG"
    return left, one, tiny, two, right


def test_hidden_exon_is_found(spark):
    rng = random.Random(31)
    rows, want = [], {}
    for n in (7, 10, 15):
        left, one, tiny, two, right = hidden_exon(rng, n)
        genome, est = left + one + tiny + two + right, left + tiny + right
        # the small exon hangs on the left exon, with errors
        rows.append((f"in{n}", [(1, 50 + n, 1, 50 + n), (51 + n, 100 + n, len(genome) - 49, len(genome))], est, genome))
        a = 50 + len(one)
        want[f"in{n}"] = [(1, 50, 1, 50), (51, 50 + n, a + 1, a + n), (51 + n, 100 + n, len(genome) - 49, len(genome))]
    left, one, _, two, right = hidden_exon(rng, 6)
    fine = left + one + right
    rows.append(("fine", [(1, 50, 1, 50), (51, 100, len(fine) - 49, len(fine))], left + right, fine))
    want["fine"] = rows[-1][1]
    df = spark.createDataFrame(rows, f"id string, exons {EXONS}, est string, genome string")
    got = {r["id"]: [tuple(e) for e in r["exons"]] for r in small_exons.with_hidden(df, ["id"]).collect()}
    assert got["fine"] == want["fine"]
    for k, x in want.items():
        if k == "fine":
            continue
        est, genome = next((r[2], r[3]) for r in rows if r[0] == k)
        (a, b, c) = got[k]
        # borders may take bases that the small exon and its neighbours share
        assert abs(b[2] - x[1][2]) <= 3 and abs(b[3] - x[1][3]) <= 3
        assert est[b[0] - 1 : b[1]] == genome[b[2] - 1 : b[3]] and a[1] + 1 == b[0] and b[1] + 1 == c[0]
        assert genome[a[3] : a[3] + 2] == "GT" == genome[b[3] : b[3] + 2] and genome[b[2] - 3 : b[2] - 1] == genome[c[2] - 3 : c[2] - 1] == "AG"


def test_hidden_candidates():
    """All exact occurrences, by trying every border."""
    rng = random.Random(17)
    for _ in range(60):
        e1, e2 = bases(rng, 12), bases(rng, 12)
        between = "".join(rng.choices("AC", k=rng.randint(20, 60))) + e1[6:] + e2[:6] + bases(rng, 20)
        gap = rng.choice(["", "A", "CA"])
        got = {(r[2], r[3], r[4], r[5], r[7]) for r in small_exons.hidden(e1, e1, e2, e2, 0, 0, between, gap, 5)}
        est, gen = e1 + gap + e2, e1 + between + e2
        last, glast = len(est) - 6, len(gen) - 6
        want = set()
        for a in range(7):
            for b in range(7):
                exon = est[6 + a : last - b]
                if len(exon) >= 6:
                    want |= {(6 + a, last - b, 6 + a, at, glast - b) for at in range(6 + a + 5, glast - b - 5 - len(exon) + 1) if gen.startswith(exon, at)}
        assert got == want


def test_ordered_merge(spark):
    """Adding equal ends up first gives what joining the transcripts one by one gives."""
    rng = random.Random(19)
    for key in range(6):
        rows = [("l", f"k{key}", f"T{i:03d}", rng.randrange(5), 100 + rng.randrange(8), rng.random() < 0.4, rng.random() < 0.1) for i in range(60)]
        want = []
        for _, k, tid, left, right, polya, refseq in rows:
            if refseq:
                want.append([tid, left, right, polya, 1, True])
                continue
            for c in want:
                if c[5]:
                    continue
                if polya:
                    fits = right == c[2] if c[3] else c[2] <= right
                else:
                    fits = c[2] >= right if c[3] else True
                if fits:
                    c[1], c[2], c[3], c[4] = min(c[1], left), c[2] if c[3] else right if polya else max(right, c[2]), c[3] or polya, c[4] + 1
                    break
            else:
                want.append([tid, left, right, polya, 1, False])
        df = spark.createDataFrame(rows, "locus string, site_key string, tid string, left_end bigint, right_end bigint, polya boolean, refseq boolean").repartition(4)
        got = chains.merge_in_order(df, ["locus"]).collect()
        assert sorted((r["tid"], r["left_end"], r["right_end"], r["polya"], r["support"]) for r in got) == sorted(tuple(c[:5]) for c in want)
