"""Token alignment, the Merkle manifest and archives against brute force."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from splicework.llm import alignment, merkle, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk bigint, place int, slot int, pair int, tree string, digest string, n int"


def models():
    out = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            out.append(f.read())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(120)] + ["Don't", "2024", "12,5", "€", "中文字", "😀", "<s>", "<|endoftext|>", " ", "ሀለ"]
    texts = [None, "", " ", "  two  spaces ", "\n\n\t", "one", "a▁b", "x" * 5000, "ab" * 3000, " " * 3000, "é", "<unk></s>", "<|endoftext|>", "same", "same"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)] + [" ".join(rng.choices(words, k=20000))]
    made = [(i, t, ("en", "de", None, "", "fr")[rng.randrange(5)], ("s1", None)[i % 2], len(t or ""), 1, 2, 3, 4, "t", "d", 5) for i, t in enumerate(texts)]
    return made + [(None, "no ID", "en", None, None, 1, 2, 3, 4, "t", "d", 5), (3, "Again", "alone", "s", 5, 1, 2, 3, 4, "t", "d", 5), made[9], made[9], (9, "other Text", *made[9][2:])]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def aligned(text):
    """(a spans, b spans, groups as (a, b) lists, links), or None without tokens."""
    a_json, b_model = models()
    if not hasattr(aligned, "models"):
        a = Tokenizer.from_str(a_json.decode())
        a.encode_special_tokens = True
        aligned.models = a, SentencePieceProcessor(model_proto=b_model), alignment.a_token_bytes(a_json.decode()), alignment.b_token_bytes(b_model)
    a, b, a_bytes, b_bytes = aligned.models
    if not text:
        return None
    raw, spans = (" " + text).encode(), []
    for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, a_bytes), (b.encode(text), b_bytes)):
        if b"".join(table[i] for i in ids) != raw:
            return None
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(table[i]), i))
            at += len(table[i])
        spans.append(own)
    groups, at = [], [0, 0]
    for end in sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]}):
        groups.append([])
        for k, own in enumerate(spans):
            first = at[k]
            while at[k] < len(own) and own[at[k]][1] <= end:
                at[k] += 1
            groups[-1].append(own[first : at[k]])
    return spans, groups, [(x[2], y[2]) for g in groups for x in g[0] for y in g[1] if x[0] < y[1] and y[0] < x[1]]


def test_alignment(docs, none, rows, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 7_000)
    count, best = Counter(), defaultdict(int)
    found = [aligned(r[1]) for r in rows]
    for x in found:
        count.update(set(x[2]) if x else ())
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = []
    for r, x in zip(rows, found, strict=True):
        if x is None:
            want.append((r[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        (a, b), groups, links = x
        text = ";".join("|".join(",".join(str(t[2]) for t in side) for side in g) for g in groups)
        want.append((r[0], len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha(text)))
    got = alignment.digests(docs, *models(), public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(x is None for x in found) == 3
    pairs = alignment.link_counts(docs, *models(), public_tokenizers.PATTERN).collect()
    assert {(p["a"], p["b"]): (p["n_docs"], p["best"]) for p in pairs} == {p: (n, n == best[p[0]]) for p, n in count.items()}
    spans = alignment.groups(docs, *models(), public_tokenizers.PATTERN).collect()
    plain = [(r[0], [(min(t[0] for t in g[0]), [t[2] for t in g[0]], [t[2] for t in g[1]]) for g in x[1]] if x else []) for r, x in zip(rows, found, strict=True)]
    assert sorted(repr((r["doc_id"], [(g["start"], g["a"], g["b"]) for g in r["groups"]])) for r in spans) == sorted(map(repr, plain))
    assert alignment.digests(none, *models(), public_tokenizers.PATTERN).count() == 0


def test_quick_encoder_is_the_files():
    """The two ways of encoding A agree on random strings of settled letters."""
    e = alignment.Encoders(*models(), public_tokenizers.PATTERN)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçABCXYZ0123456789 \n\t.,;:'’\"-—()[]%$€中文一二кот"
    for _ in range(3000):
        text = " " + "".join(rng.choices(letters, k=rng.randint(1, 60)))
        assert list(e.encode_a(text, text.encode())) == e.slow_a.encode(text, add_special_tokens=False).ids


def test_intervals_without_tiling():
    """Gaps and unequal ends: groups are the connected components of overlaps."""
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        sides = []
        for _ in range(2):
            cuts = sorted(rng.sample(range(40), 2 * rng.randint(1, 8)))
            sides.append((np.array(cuts[::2]), np.array(cuts[1::2])))
        (a, a_end), (b, b_end) = sides
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] < b_end[j] and b[j] < a_end[i]]
        assert list(zip(*map(list, alignment.overlaps(a, a_end, b, b_end)), strict=True)) == pairs
        a_group, b_group, _ = alignment.coalesce(a, a_end, b, b_end)
        assert all(a_group[i] == b_group[j] for i, j in pairs)
        joined = {(0, i): {(0, i)} for i in range(len(a))} | {(1, j): {(1, j)} for j in range(len(b))}
        for i, j in pairs:
            whole = joined[0, i] | joined[1, j]
            for x in whole:
                joined[x] = whole
        assert len({*a_group, *b_group}) == len({frozenset(x) for x in joined.values()})


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, i, fanout):
    out = []
    for level in tree[:-1]:
        first = i // fanout * fanout
        run = level[first : first + fanout]
        out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        i //= fanout
    return out


def plain_manifest(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    digest = lambda r, text: leaf((r[0], r[3], r[2], r[4], text))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1])))
        trees[g] = levels([digest(r, r[1]) for r in groups[g]], fanout)
    top = levels([trees[g][-1][0] for g in order], fanout)
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            proof = siblings(trees[g], i, fanout) + siblings(top, k, fanout)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            folded = digest(r, r[1].translate(LOWER)) if changed else trees[g][0][i]
            for before, after in proof:
                folded = sha(before + folded + after)
            yield r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], sha("".join(b + a for b, a in proof)), folded, folded == top[-1][0]


@pytest.mark.parametrize(("fanout", "block_levels"), [(8, 4), (2, 1), (3, 2), (8, 1)])
def test_manifest(docs, none, rows, fanout, block_levels):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(docs, tampered=tampered, fanout=fanout, block_levels=block_levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(repr, map(tuple, got.collect())))
    assert got == sorted(map(repr, plain_manifest(rows, fanout)))
    assert any("False" in x for x in got)
    assert merkle.manifest(none, tampered=tampered).count() == 0


def test_manifest_of_one_group(spark):
    """A lone group's root is the root, a lone row's leaf too."""
    for n in (1, 2, 9):
        rows = [(i, f"Text {i}", "en", None, i) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        got = merkle.manifest(docs)
        assert sorted(map(repr, map(tuple, got.drop("folded_root", "verified").collect()))) == sorted(repr(x[:5]) for x in plain_manifest(rows, 8))
        assert got.filter("verified").count() == n


def test_external_queue():
    rng = random.Random(1)
    queue, plain = merkle.ExternalQueue(16), []
    for step in range(3000):
        if plain and rng.random() < 0.4:
            assert queue.first() == plain[0][0]
            assert queue.pop() == plain.pop(0)[2]
        else:
            plain.append(((rng.randrange(20), rng.randrange(20)), step, f"v{step}"))
            plain.sort()
            queue.push(plain[[x[1] for x in plain].index(step)][0], f"v{step}")
    while plain:
        assert queue.pop() == plain.pop(0)[2]
    assert queue.first() is None


def test_small_queue_gives_the_same_proofs():
    nodes = [sha(str(i)) for i in range(70)]
    tree = merkle.evaluate(nodes, 4, 3, most=4)
    assert tree == merkle.evaluate(nodes, 4, 3) and [len(x) for x in tree] == [70, 24, 8, 3, 1]
    assert merkle.sweep(tree, [("b", "a")], 3, most=4) == [[*siblings(tree, i, 3), ("b", "a")] for i in range(70)]


PAGES = "page_id bigint, url string, html string, digest string, page int, n int, payload string, last int"


def pages():
    html = [None, "", "<p>a</p>", "<p>é€</p>\r\n\r\nx", "<p>a</p>", "", "y" * 300_000, "<p>a</p>", "z\r\n\r\n\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"]
    out = [(i, f"http://h{i % 3}.example/{i}" if i % 4 else None, h, "d", 1, 2, "p", 3) for i, h in enumerate(html)]
    return out + [out[2], out[7], out[7], (None, "http://x.example/\r\nInjected: 1", "<p>a</p>", "d", 1, 2, "p", 3), (-5, "http://y.example/", "only", "d", 1, 2, "p", 3), (None, None, "nobody", "d", 1, 2, "p", 3)]


def test_archive(spark, tmp_path):
    spark.createDataFrame(pages(), PAGES).repartition(3).write.parquet(str(tmp_path / "pages"))
    made = spark.read.parquet(str(tmp_path / "pages"))
    path = warc.archive(made)
    got = warc.report(spark, path).collect()
    groups = defaultdict(list)
    for p in pages():
        groups[(p[2] or "").encode()].append(p[0])
    want = []
    for data, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want += [(i, len(data), digest, "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(data), digest, "response", None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    # headers are whole, an odd url makes no header of its own, payloads come back exactly
    full = warc.read(spark, path).filter("record_type = 'response'").collect()
    assert {bytes(r["payload"]) for r in full} == set(groups)
    assert warc.read(spark, path).filter("target_uri LIKE '%Injected: 1'").count() == 1
    empty = warc.archive(made.limit(0))
    assert warc.report(spark, empty).count() == 0
    least = warc.records_of(made, least_bytes=10).filter("record_type = 'revisit'").collect()
    assert all(r["payload_length"] >= 10 for r in least) is True and len(least) == 0


def test_pushdown(spark, tmp_path):
    """What is pushed agrees with what Spark filters by itself, and payloads that aren't
    wanted are never decoded."""
    path = str(tmp_path / "w")
    made = spark.createDataFrame([(f"<urn:x:{i}>", ("response", "metadata", "revisit")[i % 3], None if i % 5 == 0 else f"http://h{i}/", i, bytearray(b"p%d" % i)) for i in range(40)], "record_id string, record_type string, target_uri string, payload_length bigint, payload binary")
    warc.write(made.repartition(2), path, fileBytes=400)
    rows = made.collect()
    whole = warc.read(spark, path, partitionBytes=500)
    assert whole.rdd.getNumPartitions() > 3 and whole.filter("record_type != 'warcinfo'").count() == 40
    for predicate in ("record_type = 'response'", "record_type IN ('revisit', 'metadata') AND target_uri IS NULL", "target_uri LIKE 'http://h1%'", "NOT target_uri LIKE '%2/'", "payload_length >= 30 AND payload_length < 35", "target_uri > 'http://h30/'", "record_type <> 'response'", "target_uri <=> NULL", "content_length = 2", "record_type = 'response' OR payload_length = 1"):
        got = whole.filter("record_type <> 'warcinfo'").filter(predicate).select("record_id", "payload")
        want = made.withColumn("content_length", F.length("payload")).filter(predicate)
        assert sorted((r[0], bytes(r[1])) for r in got.collect()) == sorted((r["record_id"], bytes(r["payload"])) for r in want.collect()), predicate
    plan = whole.filter("record_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "EqualTo(record_type,response)" not in plan.split("BatchScan")[0]
    assert len(rows) == 40


class Counting:
    def __init__(self, file):
        self.file, self.bytes = file, 0

    def read(self, n):
        data = self.file.read(n)
        self.bytes += len(data)
        return data

    def __getattr__(self, name):
        return getattr(self.file, name)


def test_skips_what_is_not_asked(tmp_path):
    import pyarrow as pa

    noise = random.Random(2).randbytes(1 << 20)
    data = b"".join(warc.member(warc.record({"WARC-Type": t}, noise)) for t in ("resource", "response", "resource"))
    (tmp_path / "a.warc.gz").write_bytes(data)
    file = Counting(pa.OSFile(str(tmp_path / "a.warc.gz")))
    assert [h["warc-type"] for h in warc._Members(file)] == ["resource", "response", "resource"]
    assert file.bytes <= 3 * warc.HEAD_BYTES


def test_foreign_files(spark, tmp_path):
    """Plain files, members without lengths, continued header lines, long headers."""
    records = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:{i}>", "X-Long": "v" * 5000, "WARC-Target-URI": "http://a/\r\n b"}, b"body %d" % i * 50_000) for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "_c.warc").write_bytes(b"no archive")
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in got) == sorted(2 * [(f"<urn:{i}>", b"body %d" % i * 50_000) for i in range(3)])
    assert {r["target_uri"] for r in got} == {"http://a/ b"}
