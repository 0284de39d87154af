"""Queries read whole texts and tables: on long texts and high ids they give the rows of
their SQL, or of brute force."""

import random

import duckdb
import pytest

from splicework.operators import align
from splicework.plans import driver_queries, queries_sequence

from .test_queries import rows

QUERIES, SQL = driver_queries.queries(), driver_queries.oracle_sql()


def sample(path, table, of):
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.01/{table}.parquet' WHERE {of}) TO '{path}/{table}.parquet' (FORMAT parquet)")


def same_rows(spark, path, table, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    got, want = QUERIES[name](spark, path).toPandas(), c.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
    return len(want)


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    sample(path, "documents", "length(text) BETWEEN 600 AND 9000 AND doc_id < 300")
    return path


@pytest.mark.parametrize("name", [n for n in SQL if "seq AS (SELECT doc_id, source, translate(" in SQL[n]])
def test_whole_texts(spark, long_texts, name):
    assert same_rows(spark, long_texts, "documents", name)


def edits(a, b):
    """All prefix pairs, cell by cell."""
    t = [[j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(t[-1][j] + 1, row[-1] + 1, t[-1][j - 1] + (x != y)))
        t.append(row)
    return t


def scores(a, b):
    t = [[-j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [-i]
        for j, y in enumerate(b, 1):
            row.append(max(t[-1][j] - 1, row[-1] - 1, t[-1][j - 1] + (1 if x == y else -1)))
        t.append(row)
    return t


def test_whole_alignments(spark, tmp_path):
    words = ["acgt gatt aca", "ttgacca gat", "cagg tacc", "gat tacag", "aaccg gtt"]
    texts = [" ".join(words[(i * (k + 2) + i // 7) % 5] + "acg"[(i + k) % 3] for i in range(60)) for k in range(4)]
    texts[1] = texts[0][:-40] + "ccgg" + texts[0][-37:]  # near to the first
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    bases = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    seq = ["".join(x for x in t if x.isalpha()).translate(bases) for t in texts]
    names = ("f17_border_split", "f18_gap_alignment", "f19_global_alignment", "f21_common_factor", "f22_best_cut", "f28_best_affix", "p12_splice_refinement")
    run = {n: {(r["doc_id"], r["piece"]): r for r in QUERIES[n](spark, str(tmp_path)).collect()} for n in names}
    size = queries_sequence.PIECE
    pieces = {(k, i // size): (seq[k][i : i + size], seq[k + 1][i : i + size]) for k in range(3) for i in range(0, max(len(seq[k]), len(seq[k + 1])), size)}
    assert all(set(r) == set(pieces) for r in run.values()) and len(pieces) > 18
    for k, (a, b) in pieces.items():
        t = edits(a, b)
        r = run["f19_global_alignment"][k]
        assert (r["est"].replace("-", ""), r["gen"].replace("-", ""), r["edits"]) == (a, b, t[-1][-1])
        assert sum(x != y for x, y in zip(r["est"], r["gen"], strict=True)) == r["edits"]
        r = run["f22_best_cut"][k]
        assert (r["cut"], r["edits"]) == (t[-1].index(min(t[-1])), min(t[-1]))
        best = (0.17, 0, 0)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                if a[i - 1] == b[j - 1] and 2 * t[i][j] / (i + j) <= best[0]:
                    best = (2 * t[i][j] / (i + j), i, j)
        assert tuple(run["f28_best_affix"][k])[2:] == best[1:]
        n = max(n for n in range(len(a) + 1) if any(a[i : i + n] in b for i in range(len(a) - n + 1)))
        r = run["f21_common_factor"][k]
        assert r["length"] == n
        assert a[r["a_start"] : r["a_start"] + n] == b[r["b_start"] : r["b_start"] + n]
        back = edits(a[::-1], b[::-1][: len(a) + 3])
        head = edits(a, b[: len(a) + 3])
        least = min((head[c][i] + back[len(a) - c][j] for c in range(len(a) + 1) for i in (head[c].index(min(head[c])),) for j in (back[len(a) - c].index(min(back[len(a) - c])),) if i + j <= len(b)), default=len(a))
        assert run["f17_border_split"][k]["edits"] == least
        gen = a[: len(a) // 2] + b + a[len(a) // 2 :]
        left, right = scores(a, gen), scores(a[::-1], gen[::-1])
        m = max(left[i][j] + max(right[len(a) - i][: len(gen) - j + 1]) for i in range(len(a) + 1) for j in range(len(gen) + 1))
        r = run["f18_gap_alignment"][k]
        assert r["score"] == m == len(a)
        assert a == gen[: r["intron_start"] - 1] + gen[r["intron_end"] :]
        r = run["p12_splice_refinement"][k]
        assert r["score"] is None or a == gen[: r["intron_start"] - 1] + gen[r["intron_end"] :]


def test_batches_align_as_single_pairs():
    rng = random.Random(7)
    text = lambda: "".join(rng.choices("ACGTN", weights=[5, 3, 3, 5, 1], k=rng.randint(0, 40)))
    a = [text() for _ in range(120)]
    b = [text() if i % 3 else x[:7] + text()[:20] + x[7:] for i, x in enumerate(a)]
    known = align._frequency()
    pairs = [
        (align.global_alignments, align.global_alignment),
        (align.gap_alignments, align.gap_alignment),
        (align.common_factors, align.longest_common_factor),
        (align.best_affixes, align.best_affix),
        (align.best_cuts, align.best_cut),
        (lambda x, y: align.border_splits(x, y, 3, known), lambda x, y: align.border_split(x, y, 3, known)),
    ]
    for many, one in pairs:
        assert many(a, b) == [one(x, y) for x, y in zip(a, b, strict=True)]
        assert many([], []) == [] and many([""], [""]) == [one("", "")]


@pytest.fixture(scope="module")
def high_ids(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines"))
    sample(path, "lineitem", "l_orderkey % 10 IN (3, 4)")
    return path


OF_ISOFORMS = ["g08_chain_pairs", "g12_merged_chains", "t13_inframe", "t14_competing_sites", "t15_intron_retention", "t16_skipped", "t16_outer_changes"]


@pytest.mark.parametrize("name", OF_ISOFORMS)
def test_all_isoforms(spark, high_ids, name):
    assert same_rows(spark, high_ids, "lineitem", name)


def test_all_cover_roots(spark, high_ids):
    assert same_rows(spark, high_ids, "lineitem", "j18_cover_root")


@pytest.mark.parametrize("name", ["a04_incidence", "a05_essential"])
def test_all_lines(spark, high_ids, name):
    assert same_rows(spark, high_ids, "lineitem", name)
