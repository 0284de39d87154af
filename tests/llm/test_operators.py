"""The training-data operators against brute force, on small tables with nulls, empty
and long texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from splicework.llm import bpe, chat, decontaminate, html_extract, lm, near_dup, passages, quality, queries, sharding, suffix_dedup, url_filter

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, key string, node int, x int, g string, id int, doc int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    out = [None, "", " ", "one", "two words", "a b c d", "Ünï côdé €", "x" * 900, "ab " * 400, None]
    base = [" ".join(rng.choices(words, k=rng.randint(60, 200))) for _ in range(25)]
    passage = " ".join(rng.choices(words, k=150))
    for i, t in enumerate(base):
        out.append(t)
        if i % 3 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "edit"
            out.append(" ".join(w))
        if i % 5 == 0:
            out += [t, t]
        if i % 4 == 0:
            out.append(t[:200] + passage + t[200:])
    out += ["line one here\nline one here\n" * 30, " ".join(rng.choices(words, k=3000))]
    return out


@pytest.fixture(scope="module")
def rows():
    ts = texts()
    made = [(i, t, ("en", "de", None)[i % 3], ("s1", None)[i % 2], len(t or ""), "n", "key", 1, 2, "g", 3, 4) for i, t in enumerate(ts)]
    return made + [(None, "null id text here", "en", "s1", 1, "n", "key", 1, 2, "g", 3, 4)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 8, 100])
def test_sharding(spark, docs, rows, shards):
    got = sharding.assign_shards(docs, "doc_id", "text", shards).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i or 0, shards), jump(i or 0, shards + 1)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_negative_and_text_keys(spark):
    keys = [-1, -(1 << 63), (1 << 63) - 1, 0]
    got = spark.createDataFrame([(k, "t") for k in keys], "k bigint, t string").select("k", sharding.jump_shards(F.col("k"), 1000)["shard"].alias("s")).collect()
    assert all(r["s"] == jump(r["k"], 1000) for r in got)
    assert sharding.assign_shards(spark.createDataFrame([("a", "t"), (None, None)], "k string, t string"), "k", "t", 3).count() == 2


def test_sharding_empty(none):
    assert sharding.assign_shards(none, "doc_id", "text", 4).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad">Buy</div><main><article><header>by me</header><h1>Title %d &amp; more</h1>
<p class="notice">Note<p>First&nbsp; para<br>goes <b>on<p>Second %d<form>f</form><ul><li>a<li>b</ul></article><aside>s</aside></main><section id="comments"><article class="comment">hi</article></section><footer>f</footer>"""


def test_html(spark):
    pages = [(i, f"https://h.example/{i}", PAGE % (i, i * i), 1) for i in range(8)] + [(90, None, None, 1), (91, "x://", "", 1), (92, "u", "plain &lt; text <", 1)]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string, host int")).collect()}
    for i in range(8):
        lines = got[i]["text"].split("\n")
        assert lines[:1] == [f"Title {i} & more"]
        assert f"Second {i * i}" in lines
        assert not {"Site", "Home", "Buy", "by me", "Note", "f", "s", "hi"} & set(lines)
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (90, 91, 92)] == ["", "", "plain < text <"]


def test_html_template_text_goes_but_copies_stay(spark):
    same = [(i, "https://a.example/", "<html><body><article><p>only this</p></article></body></html>") for i in range(6)]
    varied = [(10 + i, "https://b.example/", f"<html><body><article><p>Subscribe today</p><p>text {i}</p></article></body></html>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(same + varied, "page_id bigint, url string, html string")).collect()}
    assert {got[i] for i in range(6)} == {"only this"}
    assert [got[10 + i] for i in range(6)] == [f"text {i}" for i in range(6)]


HTML = "page_id bigint, url string, html string"


def optional(i):
    """A page whose article has a box without a telling name, on every other page."""
    box = f"<div class='k7'><p>Join our club</p><span>Free for all</span></div>" if i % 2 else ""
    return f"<html><body><div><p>Top line</p></div><div class='q'><h1>Head {i}</h1><p>First text {i * 7} goes on here</p>{box}<p>Last text {i * 11} ends it there</p></div><div>Made by us</div></body></html>"


def test_html_template_decides(spark):
    pages = spark.createDataFrame([(i, "http://t.example/x", optional(i)) for i in range(12)], HTML)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    want = {i: f"Head {i}\nFirst text {i * 7} goes on here\nLast text {i * 11} ends it there" for i in range(12)}
    assert got == want
    assert all(html_extract.main_text(optional(i), None) != want[i] for i in range(12))
    twice = html_extract.extract(pages.unionAll(pages)).collect()
    assert len(twice) == 24 and all(r["text"] == want[r["page_id"]] for r in twice)
    assert html_extract.extract(pages.filter("page_id < 0")).count() == 0


def test_html_classes_by_brute_force(spark):
    """Occurrence vectors as lists, without digests: equal ones are the classes."""
    rng = random.Random(3)
    parts = ["<ul><li><a>m</a></li></ul>", "<div id='b'><i>box</i> box text</div>", "<table class='t'><tr><td>cell</td></tr></table>"]
    htmls = ["<html><body><h1>Same</h1>" + "".join(p for p in parts if rng.random() < 0.6) + f"<div class='z'><p>Own text number {i}</p></div></body></html>" for i in range(40)]
    rows = [(i, f"http://{'ab'[i % 2]}.example/", h) for i, h in enumerate(htmls)]
    df = spark.createDataFrame(rows, HTML).withColumn("host", html_extract.host_of(F.col("url")))
    got = {r["host"]: r["template"] for r in html_extract.templates(df, "page_id", "html").collect()}
    for k, host in enumerate(("a.example", "b.example")):
        pages = [html_extract.Page(h) for h in htmls[k::2]]
        vectors, is_tag, own_path = {}, {}, {}
        for j, p in enumerate(pages):
            for n in p.nodes:
                if (x := p.token(n)) is not None:
                    vectors.setdefault(x, [0] * len(pages))[j] += 1
                    is_tag[x] = n[1] is None
                    own_path[x] = n[2] if n[1] is None else p.path[n[0]]
        classes = {}
        for x, v in vectors.items():
            classes.setdefault(tuple(v), set()).add(x)
        valid = {v: c for v, c in classes.items() if sum(map(bool, v)) >= html_extract.MIN_PAGES and len(c) > 1 and any(is_tag[x] for x in c)}
        root_vector = max((v for v in valid if max(v) == 1), key=lambda v: (sum(v), len(valid[v])))
        root = valid.pop(root_vector)
        assert set(got[host]["root"]) == root
        seen = {}
        order = {x: i for i, x in enumerate(got[host]["root"])}
        for p in pages:
            for _, x, g, own in html_extract.gaps(p, order):
                if not own and x is not None:
                    seen.setdefault(x, set()).add(g)
        nested = set()
        for c in valid.values():
            places = set().union(*(seen[x] for x in c))
            if len(places) == 1:
                tags = {own_path[x] for x in c if is_tag[x]}
                nested |= {(x, *places) for x in c if is_tag[x] or own_path[x] in tags}
        assert {(r["token"], r["gap"]) for r in got[host]["nested"]} == nested and nested


def test_html_odd_pages():
    start = time.time()
    for page in ("<a " * 1_700_000, '<a "' * 400_000, "<!--" * 400_000, "<p class='x" * 200_000, "<i>" * 20_000 + "</b>" * 20_000):
        assert html_extract.main_text(page, None) == ""
    assert time.time() - start < 5
    assert html_extract.main_text("<body><p>Intro text.</p><p><a href=x>A link</a></p><ul><li><a>menu</a></li></ul><p>End</p></body>", None) == "Intro text.\nA link\nEnd"
    assert html_extract.main_text('<article class="post-related-login">Hello</article>', None) == "Hello"
    assert html_extract.main_text("<article>A long first article</article><article class=b>A second one</article>", None) == "A long first article\nA second one"


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer()


def test_bpe(docs, rows, tokenizer):
    import tiktoken

    ranks, pattern = tokenizer
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for i, t, *_ in rows:
        ids = want.encode_ordinary(t or "")
        expected[(i, len(ids), sha(" ".join(map(str, ids))), sha(t or ""))] += 1
    got = bpe.digests(docs, ranks, pattern, chunk_bytes=2000).collect()
    assert Counter(tuple(r) for r in got) == expected
    encoded = bpe.encode(docs, ranks, pattern)
    back = bpe.decode(encoded, ranks).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back) == Counter((i, (t or "").encode()) for i, t, *_ in rows)


def test_bpe_words(tokenizer):
    import tiktoken

    ranks, pattern = tokenizer
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for n in (1, 2, 20, 48, 49, 300, 3000):
        word = bytes(rng.choice(b"abcdethin \xc3\xa9\xff") for _ in range(n))
        assert bpe.encode_word(word, ranks) == want._encode_single_piece(word)


def test_bpe_cut_once(spark, tokenizer):
    """Texts are read twice, for their sizes and to be cut, and never cut again."""
    import tiktoken

    ranks, pattern = tokenizer
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {i: (None, "", " \n \n", f"it's  word{i % 7} \u00e9\U0001f600{'q' * i}\x00 the the")[i % 4] for i in range(60)}
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3).mapInArrow(counted, "doc_id bigint, text string")
    got = bpe.digests(docs, ranks, pattern, chunk_bytes=100).collect()
    ids = {i: want.encode_ordinary(t or "") for i, t in texts.items()}
    assert sorted(map(tuple, got)) == [(i, len(ids[i]), sha(" ".join(map(str, ids[i]))), sha(t or "")) for i, t in sorted(texts.items())]
    assert read.value == 2 * len(texts)


def test_bpe_empty(none, tokenizer):
    assert bpe.digests(none, *tokenizer).count() == 0


def test_chat_linear(spark):
    said = r"\### Assistant: </turn> ok"
    turns = [(1, 0, "user", said, "x"), (1, 1, "assistant", said, "x"), (2, None, "assistant", None, "x"), (2, 3, "a:b", "\n</turn>\n\\", "x"), (2, 3, "a:b", "\n</turn>\n\\", "x"), (None, 0, None, "###", "x")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, tree string")
    out = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.linear(frame))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", said), ("assistant", said)]
    assert out[1]["learned"] == said
    assert [tuple(t) for t in out[2]["turns"]] == [("assistant", ""), ("a:b", "\n</turn>\n\\"), ("a:b", "\n</turn>\n\\")]
    assert [tuple(t) for t in out[None]["turns"]] == [("", "###")]
    for r in out.values():
        assert "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]) == chat_escaped(r["learned"])


def chat_escaped(text):
    return re.sub(r"([\\#<])", r"\\\1", text)


def test_chat_trees(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for tree in range(6):
        parent = {0: None}
        for i in range(1, 14):
            parent[i] = rng.randrange(i)
        score = {i: rng.randint(-3, 3) for i in parent}
        rows += [(tree, i, p, "user" if i % 2 else "assistant", f"t{tree}m{i}", float(score[i])) for i, p in parent.items()]
        leaves = []
        for i in set(parent) - set(parent.values()):
            path = [i]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            leaves.append((-sum(score[j] for j in path), i, path[::-1]))
        want[tree] = [p for _, _, p in sorted(leaves)[:2]]
    rows += [(9, 1, 2, "user", "cycle", 0.0), (9, 2, 1, "user", "cycle", 0.0), (8, 5, 77, "user", "orphan", 0.0)]
    frame = spark.createDataFrame(rows, "tree int, id bigint, parent bigint, role string, text string, score double")
    got = defaultdict(list)
    for r in chat.read_back(chat.format_paths(frame, top=2)).orderBy("tree", "rank").collect():
        got[r["tree"]].append([int(t["text"].split("m")[1]) for t in r["turns"] if "m" in t["text"]])
    assert got.pop(8) == [[]]
    assert got == want


def test_lm(docs, rows):
    got = {r["doc_id"]: r for r in lm.train_and_score(docs).collect()}
    tokens = lambda t: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]
    learned = [tokens(t) for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    count, pair = Counter(w for t in learned for w in t), Counter(p for t in learned for p in zip(["<s>", *t], t))
    total, follows, seen = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, b), k in pair.items():
        total[a] += k
        follows[b] += 1
        seen[a][min(k, 3) - 1] += 1
    four = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    d, e = lm.discounts(four(pair)), lm.discounts(four(follows))
    off = lambda k, x: x[min(k, 3) - 1] if k else 0
    v, n = len(count), sum(count.values())
    h = sum(off(k, e) for k in follows.values()) / len(pair)

    def p(a, b):
        q = (follows[b] - off(follows[b], e)) / len(pair) + h / (v + 1)
        return (pair[a, b] - off(pair[a, b], d) + sum(x * y for x, y in zip(d, seen[a])) * q) / total[a] if total[a] else q

    assert math.isclose(sum(p("<s>", w) for w in count) + (p("<s>", "never seen")), 1)
    for i, t, *_ in rows:
        w, r = tokens(t), got[i]
        assert r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w)), rel_tol=1e-9)


def test_lm_empty(none):
    assert lm.train_and_score(none).count() == 0


def statistics(t):
    w = WORDS.findall(t or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs, rows):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        n = statistics(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_outliers(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    good = [" ".join(word() for _ in range(rng.integers(80, 300))) for _ in range(300)]
    bad = [" ".join(word() + "$$$" for _ in range(150)) for _ in range(12)]
    rows = [(i, t, "en", "s") for i, t in enumerate(good + bad)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300))
    assert not any(got[i] for i in range(300, 312))


def test_quality_single_outliers(spark):
    """In a clean group, an outlier in any one statistic is rejected, clean rows stay."""
    rng = np.random.default_rng(4)
    word = lambda lo=2, hi=8: "".join(rng.choice(list("abcdefghij"), rng.integers(lo, hi)))
    text = lambda n, *of: "\n".join(" ".join(word(*of) for _ in range(10)) for _ in range(n))
    good = [text(rng.integers(8, 30)) for _ in range(300)]
    few = [word(5, 8) for _ in range(40)]
    passage = [word(5, 8) for _ in range(30)]
    long, wide, symbols = text(2500, 3, 8), text(15, 25, 30), " ".join(word() + "$" for _ in range(150))
    lines = "\n".join(few[i] for i in rng.integers(0, 40, 150))
    words = " ".join(passage + [word(5, 8) for _ in range(90)] + passage)
    n_lines, n_words = statistics(lines), statistics(words)
    assert n_lines[3] > 0.6 * 150
    assert n_lines[4] < 0.1 * n_lines[0]
    assert n_words[3] == 0
    assert 0.3 * n_words[0] < n_words[4] < 0.5 * n_words[0]
    rows = [(i, t, "en", "s") for i, t in enumerate([*good, long, wide, symbols, lines, words])]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(300))
    assert [got[i]["kept"] for i in range(300, 305)] == [False] * 5
    assert not any(got[i]["base_failed"] for i in range(300, 305))


def test_mcd_resists_outliers(spark):
    """The estimate of contaminated normal rows is near the clean rows' moments."""
    rng = np.random.default_rng(1)
    scale = np.array([1.0, 0.5, 0.4, 0.6, 0.8])
    x = rng.normal(size=(4000, 5)) * scale
    x[:400] += 30
    frame = spark.createDataFrame([("en", "s", [float(v) for v in r]) for r in x], "lang string, source string, x array<double>")
    model = quality.fit(frame).first()
    assert np.abs(np.array(model["mean"])).max() < 0.1
    assert np.allclose(np.diag(np.array(model["cov"]).reshape(5, 5)), scale**2, rtol=0.15)


def test_mcd_least_determinant(spark):
    """Against all subsets of 75 % of small groups with outliers: no determinant is less
    than the least, and most groups have it (17 of these 20)."""
    rng = np.random.default_rng(0)
    groups = {f"g{k}": rng.normal(size=(14, 5)) @ rng.normal(size=(5, 5)) for k in range(20)}
    for x in groups.values():
        x[:3] += 6 * rng.normal(size=5)
    frame = spark.createDataFrame([(g, [float(v) for v in r]) for g, x in groups.items() for r in x], "g string, x array<double>")
    got = {r["g"]: r for r in quality.concentrate(frame).collect()}
    floors, factor = np.diag(np.square(quality.FLOORS)), quality._consistency(quality.H)
    above = []
    for g, x in groups.items():
        least = min(np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) * factor + floors)[1] for s in combinations(range(14), 11))
        assert got[g]["n"] == 11
        above.append(got[g]["logdet"] - least)
    assert min(above) > -1e-6
    assert sum(a < 1e-6 for a in above) >= 15


def test_mcd_ties(spark):
    """Rows at the same distance as the last one that is kept are kept too."""
    rows = [("g", [1.0, 2.0, 0.5, 0.0, 0.25])] * 20 + [("g", [9.0, 9.0, 9.0, 9.0, 9.0])] * 5
    got = quality.concentrate(spark.createDataFrame(rows, "g string, x array<double>")).first()
    assert got["n"] == 20
    assert list(got["mean"]) == pytest.approx([1.0, 2.0, 0.5, 0.0, 0.25])


def test_quality_empty(none):
    assert quality.judge(none).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_columnwise_order(alphabet, monkeypatch):
    rng = random.Random(11)
    for _ in range(60):
        blocks = [np.array([ord(rng.choice(alphabet)) for _ in range(rng.randint(1, 14))], np.uint64) for _ in range(rng.randint(1, 7))]
        suffixes = [tuple(b[i:]) for b in blocks for i in range(len(b))]

        def shared(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        want = [max((shared(x, y) for j, y in enumerate(suffixes) if j != i), default=0) for i, x in enumerate(suffixes)]
        monkeypatch.setattr(suffix_dedup.ColumnwiseOrder, "BLOCK", rng.choice([1, 2, 3, 7, 1 << 16]))
        assert list(suffix_dedup.common_blocks(blocks)) == want
        least = rng.randint(1, 4)
        begin = Counter(x[:least] for x in suffixes if len(x) >= least)
        group = list(suffix_dedup.alike(blocks, least))
        assert [g >= 0 for g in group] == [begin[x[:least]] > 1 for x in suffixes]
        assert all((group[i] == group[j]) == (x[:least] == suffixes[j][:least]) for i, x in enumerate(suffixes) for j in range(i) if min(group[i], group[j]) >= 0)


def cut(ts, n=400):
    seen = Counter(t[i : i + n] for t in ts for i in range(len(t) - n + 1))
    out = []
    for t in ts:
        hit = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        out.append((len(t), sum(hit), sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit)), sha(bytes(b for b, h in zip(t, hit) if not h))))
    return out


@pytest.mark.parametrize("many", [2000, 3])
def test_suffix_dedup(docs, rows, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    want = Counter((r[0], *c) for r, c in zip(rows, cut([(t or "").encode() for _, t, *_ in rows]), strict=True))
    assert sum(v for k, v in want.items() if k[2]) > 5
    monkeypatch.setattr(suffix_dedup, "CROWD", 1 if many < 5 else 4000)
    got = [tuple(r) for r in suffix_dedup.report(docs).collect()]
    assert Counter(r[:5] for r in got) == want
    assert all(r[5] == (r[2] > 0) for r in got)
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns
    digest = {k[0]: k[4] for k in want}
    assert all(sha(r["text"] or "") == digest[r["doc_id"]] for r in kept.collect())


def test_suffix_dedup_empty(none):
    assert suffix_dedup.report(none).count() == 0


def test_decontaminate(spark, docs, rows):
    long = [t for _, t, *_ in rows if t and len(t.split()) > 60]
    items = [(1, " ".join(long[0].split()[5:40])), (2, "two words"), (3, None), (4, ""), (5, " ".join(long[3].split()[:13])), (5, "one"), (None, "a b c d")]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for i, t in items:
        w = split(t)
        k = min(13, len(w))
        windows += [("" if i is None else str(i), w[j : j + k]) for j in range(len(w) - k + 1) if k]
    want = Counter()
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for name, x in windows:
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    found.add(name)
        want[(i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))] += 1
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    index = decontaminate.build_index(docs)
    for most in (1 << 20, 40):  # one slice of items, and several
        got = decontaminate.document_report(decontaminate.match_phrases(index, bench, slice_bytes=most)).collect()
        assert Counter(tuple(r) for r in got) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red green filler blue"), (2, "blue x x x x red green"), (3, "red red green"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", "red green blue"), ("b", "red red")], "item_id string, text string")
    index = decontaminate.build_index(docs)
    near = lambda slop: {tuple(r) for r in decontaminate.proximity_matches(index, items, slop).collect()}
    assert near(0) == {(3, "b")}
    assert near(1) == {(1, "a"), (3, "b")}
    assert near(4) == {(1, "a"), (2, "a"), (3, "b")}


def test_decontaminate_empty(spark, none):
    assert decontaminate.decontaminate(none, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def shingle_sets(ts):
    out = []
    for t in ts:
        w = WORDS.findall(t or "")
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_near_duplicates(docs, rows):
    sets = shingle_sets([t for _, t, *_ in rows])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if rows[i][1] == rows[j][1] or a and b and len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    size = Counter(root(i) for i in range(len(rows)))
    for i, r in enumerate(rows):
        if r[0] is None:
            assert got[None]["class_id"] is None
            assert got[None]["kept"]
            continue
        assert got[r[0]]["class_id"] == root(i)
        assert got[r[0]]["class_size"] == size[root(i)]
        assert got[r[0]]["kept"] == (root(i) == i)


def test_near_duplicates_chain_without_hub(spark):
    """A drifting chain, where only neighbours are near, is one class."""
    rng = random.Random(2)
    w = [f"w{rng.random()}" for _ in range(160)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w[4 * i : 4 * i + 100])))
    sets = shingle_sets([t for _, t in rows])
    assert len(sets[0] & sets[-1]) < 0.8 * len(sets[0] | sets[-1])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_near_duplicates_with_other_counts(spark):
    """Sets that are nearly equal are linked, also where one shingle is very frequent in
    one of the two texts."""
    rng = random.Random(6)
    rows = []
    for k in range(12):
        w = " ".join(f"w{rng.random()}" for _ in range(200))
        rows += [(2 * k, w), (2 * k + 1, w + " --" * 504)]
    sets = shingle_sets([t for _, t in rows[:2]])
    assert len(sets[0] & sets[1]) > 0.95 * len(sets[0] | sets[1])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(24)}


def test_probability_jaccard():
    """Registers agree with the probability Jaccard of the weighted shingles."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 5, 60).astype(float), rng.integers(0, 5, 60).astype(float)
    value = np.arange(1, 61, dtype=np.uint64) * np.uint64(7919)
    doc = np.concatenate([np.zeros(60, int), np.ones((b > 0).sum(), int)])
    got = near_dup.signatures(2, doc, np.concatenate([value, value[b > 0]]), np.concatenate([a, b[b > 0]]), 4000)
    want = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in range(60)) for i in range(60) if b[i])
    assert abs((got[0] == got[1]).mean() - want) < 0.03


def test_near_duplicates_of_repeated_ids(spark):
    """Texts of one id are not linked through it, and neither are their companions."""
    rng = random.Random(8)
    a, b = (" ".join("".join(rng.choices("abcdef", k=6)) for _ in range(60)) for _ in range(2))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(5, a), (5, b), (6, a), (7, b), (8, near), (5, a), (None, b)]
    got = sorted((r["doc_id"] or -1, r["class_size"], r["kept"], r["class_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [x[:3] for x in got] == [(-1, 1, True), (5, 2, True), (5, 4, True), (5, 4, True), (6, 4, False), (7, 2, False), (8, 4, False)]
    ids = [x[3] for x in got]
    assert ids[2] == ids[3] == ids[4] == ids[6] and ids[1] == ids[5] != ids[2] and 5 in ids and ids[0] is None


def test_passages(spark):
    """Passages of over 50 words go from every document that has them, shorter ones stay."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcde\u00e9", k=rng.choice([1, 4, 7])))
    runs = [[word() for _ in range(n)] for n in (49, 50, 51, 52, 60, 110)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, " ".join(["x"] * 200))]
    for k in range(4, 40):
        parts = [[word() for _ in range(rng.randrange(60))] for _ in range(3)]
        parts[1:1] = [r for r in rng.sample(runs, 2)]
        rows.append((k, rng.choice(["", "\n"]) + "".join(w + rng.choice([" ", "\n", " \t"]) for p in parts for w in p)))
    found, seen = {}, {}
    for k, t in rows:
        found[k] = list(re.finditer(r"[^\x20\x09-\x0D]+", t or ""))
        for i in range(len(found[k]) - 50):
            seen.setdefault(tuple(m[0] for m in found[k][i : i + 51]), set()).add(k)
    want = {}
    for k, t in rows:
        gone = set()
        for i in range(len(found[k]) - 50):
            if len(seen[tuple(m[0] for m in found[k][i : i + 51])]) > 1:
                gone |= set(range(found[k][i].start(), found[k][i + 50].end()))
        want[k] = t and "".join(c for i, c in enumerate(t) if i not in gone)
    assert sum(want[k] != t for k, t in rows) > 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in passages.remove_passages(docs).collect()} == want
    assert passages.remove_passages(docs.filter("false")).count() == 0


@pytest.mark.parametrize("many", [2000, 3])
def test_texts_with_passages(spark, tmp_path, monkeypatch, many):
    """op7_suffix_dedup names the documents that share a passage of over 50 words, though it
    takes under 400 bytes and nothing is removed; copies, repeated ids and batches."""
    monkeypatch.setattr(passages, "MANY", many)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcde\u00e9", k=rng.choice([1, 4, 6])))
    runs = [[word() for _ in range(n)] for n in (49, 50, 51, 52, 60)]
    texts = [None, "", "a b", "a b", " ".join(["x"] * 200)]
    for k in range(60):
        parts = [[word() for _ in range(rng.randrange(60))] for _ in range(2)]
        parts[1:1] = rng.sample(runs, 1) if k % 3 else []
        texts.append("".join(w + rng.choice([" ", "\n", " \t"]) for p in parts for w in p))
    texts += [texts[5], texts[5], texts[8], texts[-1]]
    rows = [(k // 2, t) for k, t in enumerate(texts)]
    seen, shares = {}, []
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        shares.append([tuple(words[i : i + 51]) for i in range(len(words) - 50)])
        for w in shares[-1]:
            seen.setdefault(w, set()).add(k)
    want = Counter((i, len((t or "").encode()), any(len(seen[w]) > 1 for w in ws)) for (i, t), ws in zip(rows, shares, strict=True))
    for parts in (1, 7):
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts).write.parquet(f"{tmp_path}/{parts}/documents.parquet")
        got = queries.op7_suffix_dedup(spark, f"{tmp_path}/{parts}").collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["has_passages"]) for r in got) == want
        assert sum(r["has_passages"] and not r["n_removed"] for r in got) > 10 < sum(not r["has_passages"] for r in got)
    none = spark.createDataFrame(rows, "doc_id bigint, text string").filter("false")
    assert passages.texts_with_passages(none).count() == 0


def test_several_rows():
    rng = np.random.default_rng(13)
    for n in range(30):
        name, row = rng.integers(0, 12, n), rng.integers(0, 5, n)
        met, once = passages.several_rows(name, row)
        held = {k: set(row[name == k].tolist()) for k in name.tolist()}
        assert set(met.tolist()) == {r for v in held.values() if len(v) > 1 for r in v}
        assert name[once].tolist() == sorted(held)


def test_pipeline_passages(spark, tmp_path):
    """The stage also cuts passages of over 50 words that take under 400 bytes."""
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(n))
    shared, ends = text(55), [(text(80), text(80)) for _ in range(3)]
    assert len(shared) < 400
    rows = [(k, f"{a} {shared} {b}" if k else f"{a} {b}", "en", "s", 0) for k, (a, b) in enumerate(ends)]
    # what is longer between some of them leaves nothing of the others' passages
    short, rest = text(55), [text(80) for _ in range(3)]
    long = f"{text(30)} {short}"
    assert len(short) < 400 < len(long)
    rows += [(k, f"{rest[k - 3]} {long if k < 5 else short}", "en", "s", 0) for k in (3, 4, 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/d")
    got = corpus_pipeline.repeated_passages(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()
    want = [f"{a}  {b}" if k else f"{a} {b}" for k, (a, b) in enumerate(ends)] + [rest[0], rest[1], f"{rest[2]} "]
    want[3:5] = [t.removesuffix(" ") for t in want[3:5]]
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got) == [(k, t, len(t)) for k, t in enumerate(want)]


def test_components(spark, monkeypatch):
    """Edges that lead to the least node already are written once; longer ways are joined."""
    written = []
    monkeypatch.setattr(near_dup, "stash", lambda df, name, f=near_dup.stash: written.append(name) or f(df, name))
    rng = random.Random(9)
    stars = [(9 * k, 9 * k + j) for k in range(5) for j in range(1, 9)]
    chain = [(i, i + 1) for i in range(100, 111)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    for edges, most in ((stars, 1), (stars + chain + loose, 9)):
        least = {x: x for e in edges for x in e}
        for _ in least:
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        written.clear()
        got = near_dup.components(spark.createDataFrame(edges + edges[:3], "a bigint, b bigint")).collect()
        assert sorted(map(tuple, got)) == sorted((x, m) for x, m in least.items() if x != m)
        assert len(written) <= most


def test_near_duplicates_empty(none):
    assert near_dup.near_duplicates(none).count() == 0


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b.example.com", "/", "block"), ("example.co", "/", "block")]
    hosts = ["com", "example.com", "www.example.com", "x.www.example.com", "notexample.com", "b.example.com", "a.b.example.com", "net", "x.net", "ne", "example.co", "example.comx", "EXAMPLE.com", "example-x.com", "", "com.", ".com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/x", "/es/", "/en", "?q", "/en/?a#b", "#/en/")] + [None, "", "no scheme", "://", "a://b://c/en/"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls * 2)], "page_id bigint, url string, stack string, part int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == 2 * len(urls)
    for i, u in enumerate(urls * 2):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")


def test_url_rules_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert tuple(url_filter.judge_urls(pages, rules).first()) == (1, "a.b", "/c", None, "allow")
