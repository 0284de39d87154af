"""Main text of web pages by equivalence classes of tokens.

Tokens of a page are its tags, told apart by their path, and its text nodes. A token's
occurrence vector holds its count on every page of the host. Tokens with equal vectors
are an equivalence class: they come from one part of the host's template. Vectors are
compared by their length, their sum and two sums of digests of (page, count), so that
counting is a plain grouped aggregation and a host may have any number of pages.

The root class has tokens that occur once on a page, on the most pages; its tokens in
order cut each page into gaps. Another class is nested in the template if at least
MIN_PAGES pages have it, it has a tag, and all its tokens stand in one and the same gap
of every page. Template text is what the root class has, and what a nested class has
inside its own tags. All other text fills slots.

The main slot is found by its text: of the elements (by path) the host's slot text is
summed up for, articles or else main elements with a good share of it, or else the
deepest element with nearly all of it. Names are hints: navigation, headers, footers,
asides, forms, adverts, notices and reader comments, by element, role, class or id, don't
count unless nothing else has text, and are left out inside the main slot. Links don't
count, but are kept inside the main slot, but for lists that are nothing but links.

Defined cases: a null or empty page has empty text; a null url is a host of its own
(the empty one); repeated rows count each and give rows each; pages of hosts with fewer
than MIN_PAGES pages, and pages without text in their host's main slot, are judged by
their own text, without a template; a text that is template all through stays; an empty
table gives an empty result; other columns of the input are ignored. Markup that is never
closed ends with the page; parsing is linear in the page.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stash
from .url_filter import host_of

MIN_PAGES = 5
MIN_TOKENS = 2
#: Bytes of templates that are sent to all executors; more are joined by host.
BROADCAST_BYTES = 32 << 20
#: Share of the slot text that makes an article, and an element of any other name, the main slot.
ARTICLE_SHARE, ELEMENT_SHARE = 0.2, 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<!?/?[a-zA-Z](?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements that end a block where they start and where they end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose end tags are often missing or meaningless for the path.
_LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOT_MAIN = frozenset("nav header footer aside form head button select menu dialog".split())
_NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
_NOT_MAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead notice notices notification cookie cookies consent gdpr popup modal overlay newsletter subscribe signup paywall share sharing social related recommended comment comments reply replies respond disqus feedback form login search widget pagination pager toolbar".split()
)
_CONTENT_WORDS = frozenset("content article post entry story".split())
_KEEP_OPEN = frozenset("html body article main".split())
_LISTS = frozenset("ul ol dl table menu".split())


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def _named(tag: str) -> tuple[str, str, set[str]]:
    """Classes and ids as written, the role, and the words of classes and ids."""
    names, role = [], ""
    for m in _ATTRIBUTE.finditer(tag):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.lower()
        else:
            names.append(value.lower())
    return " ".join(names), role, {w for n in names for w in _WORD.findall(n)}


class Page:
    """A page's elements and tokens in order.

    Elements (number 0 is the page itself) have lists: parent, path (a hash), kind (0
    article, 1 main, 2 other), barred (named as something that isn't main text), linked
    and listed (inside a link, a list). Nodes are (element, text or None for a tag, block).
    """

    def __init__(self, text: str):
        self.parent, self.path, self.kind, self.barred, self.linked, self.listed = [-1], [0], [2], [False], [False], [False]
        self.nodes: list[tuple[int, str | None, int]] = []
        names_of, stack, where, block = [""], [0], {}, 0
        kept = [0]  # places in the stack of elements that only their own kind closes

        def pop(size: int) -> None:
            while len(stack) > size:
                where[names_of[stack.pop()]].pop()
                if kept[-1] == len(stack):
                    kept.pop()

        for m in _TOKEN.finditer(text):
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                self.nodes.append((stack[-1], piece, block))
                continue
            if m[1]:
                block += m[1].lower() == "title"
                continue
            t = _TAG.match(piece)
            if not t or not piece.endswith(">"):
                continue
            name = t[2].lower()
            if name in BLOCKS:
                block += 1
            elif name == "br":
                self.nodes.append((stack[-1], " ", block))
            if name in _VOID:
                continue
            if t[1]:
                if where.get(name) and (name in _KEEP_OPEN or where[name][-1] > kept[-1]):
                    pop(where[name][-1])
                continue
            # a start ends the element before it whose end tag is missing
            top = names_of[stack[-1]]
            if top == "p" and name in BLOCKS or top == name and name in _LOOSE:
                pop(len(stack) - 1)
            names, role, words = _named(piece) if "=" in piece else ("", "", set())
            up = stack[-1]
            barred = name in _NOT_MAIN or role in _NOT_MAIN_ROLES or bool(_NOT_MAIN_WORDS & words)
            kind = 0 if name == "article" else 1 if name == "main" or role == "main" else 2
            if name in ("html", "body") or kind < 2 and _CONTENT_WORDS & words:
                barred = False
            # the text of a plain paragraph or item is told apart by its parent, as its end may be missing
            plain = name in _LOOSE and not names and not barred
            here = _hash(self.path[up], name, names)
            if plain:
                self.nodes.append((up, None, here))
                continue
            e = len(self.path)
            self.parent.append(up)
            self.path.append(here)
            self.kind.append(kind)
            self.barred.append(barred)
            self.linked.append(self.linked[up] or name == "a")
            self.listed.append(self.listed[up] or name in _LISTS)
            names_of.append(name)
            self.nodes.append((e, None, here))
            where.setdefault(name, []).append(len(stack))
            if name in _KEEP_OPEN:
                kept.append(len(stack))
            stack.append(e)
        #: Elements with a barred one around them, or barred themselves.
        self.under: list[bool] = []
        for e, p in enumerate(self.parent):
            self.under.append(self.barred[e] or p >= 0 and self.under[p])

    def token(self, node: tuple[int, str | None, int]) -> int | None:
        """The token's number; None for blank text and text of barred elements."""
        e, text, at = node
        if text is None:
            return at
        return _hash(self.path[e], "text", text) if text.strip() and not self.under[e] else None

    def weights(self, nodes: list[tuple[int, str | None, int]]) -> dict[int, list[int]]:
        """Of each path: depth, kind, and the letters of these nodes inside it, without
        links and barred elements."""
        letters, depth = [0] * len(self.path), [0] * len(self.path)
        for e, text, _ in nodes:
            if text is not None and not self.under[e] and not self.linked[e]:
                letters[e] += len(text.strip())
        for e in range(len(self.path) - 1, 0, -1):
            letters[self.parent[e]] += letters[e]
        out: dict[int, list[int]] = {}
        for e, path in enumerate(self.path):
            depth[e] = depth[self.parent[e]] + 1 if e else 0
            out.setdefault(path, [depth[e], self.kind[e], 0])[2] += letters[e]
        return out


def main_paths(weights: dict[int, list[int]]) -> list[int]:
    """The paths of the main slot: articles, or else main elements, with ARTICLE_SHARE of
    all letters or more, or else the deepest path with ELEMENT_SHARE."""
    total = max((w[2] for w in weights.values()), default=0)
    for kind in (0, 1):
        found = sorted(p for p, w in weights.items() if w[1] == kind and w[2] and w[2] >= ARTICLE_SHARE * total)
        if found:
            return found
    return [max((w[0], w[2], p) for p, w in weights.items() if w[2] >= ELEMENT_SHARE * total)[2]] if total else []


def _text(page: Page, bases: list[int], nodes: list[tuple[int, str | None, int]]) -> str:
    """The text of the nodes inside the elements of these paths."""
    inside, out, article = [], [], []
    for e, p in enumerate(page.parent):
        base = page.path[e] in bases
        around = p >= 0 and inside[p]
        inside.append(base or around)
        out.append(around and (out[p] or page.barred[e]))
        article.append(base and page.kind[e] < 2 or around and article[p])
    blocks: dict[int, list[tuple[int, str]]] = {}
    for e, text, block in nodes:
        if text is not None and inside[e] and not out[e]:
            blocks.setdefault(block, []).append((e, text))
    lines = []
    for own in blocks.values():
        # outside an article, a list of links only is a menu
        if all(not t.strip() or page.linked[e] and page.listed[e] and not article[e] for e, t in own):
            continue
        lines.append(" ".join(htmllib.unescape("".join(t for _, t in own)).split()))
    return "\n".join(x for x in lines if x)


def gaps(page: Page, root: dict[int, int]) -> Iterator[tuple[tuple[int, str | None, int], int | None, int, bool]]:
    """Each node with its token, the gap of the root class it is in, and whether it is
    itself a root token, which starts the next gap. Root tokens come in order."""
    at = -1
    for node in page.nodes:
        token = page.token(node)
        r = root.get(token, -1) if token is not None else -1
        if r > at:
            at = r
            yield node, token, at, True
        else:
            yield node, token, at, False


def main_text(html: str | None, template: dict | None) -> str:
    """The text of the page's main slot. ``template`` has root (tokens in order), nested
    (token and gap) and main (paths), or is None."""
    page = Page(html or "")
    texts = [n for n in page.nodes if n[1] is not None]
    slots = texts
    if template:
        nested = {(t["token"], t["gap"]) for t in template["nested"]}
        root = {t: i for i, t in enumerate(template["root"])}
        slots = [n for n, token, gap, own in gaps(page, root) if n[1] is not None and not own and (token, gap) not in nested]
        for nodes in (slots, texts):
            if out := _text(page, list(template["main"]), nodes):
                return out
    bases = main_paths(page.weights(slots)) or main_paths(page.weights(texts))
    if not bases:  # all is linked, or named as something else
        whole = Page(html or "")
        whole.under, whole.linked = [False] * len(whole.path), [False] * len(whole.path)
        bases = main_paths(whole.weights(texts))
    return _text(page, bases, slots) or _text(page, bases, texts)


def _batches(rows: Iterator[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    known = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, known[k]) for c, k in zip(cols, kinds, strict=True)], list(names))


_TOKENS = "host string, token bigint, is_text boolean, path bigint, n bigint, total bigint, d1 bigint, d2 bigint, place bigint"


def tokens(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Tokens of each host, partly added up: pages and occurrences, two sums of digests
    of the vector, and the sum of first places. ``path`` is a tag's own, or that of the
    element around a text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for host, key, html in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(html or "")
                own: dict[int, list] = {}
                for i, n in enumerate(page.nodes):
                    token = page.token(n)
                    if token is not None:
                        own.setdefault(token, [0, i, n[1] is not None, n[2] if n[1] is None else page.path[n[0]]])[0] += 1
                for token, (count, place, is_text, path) in own.items():
                    mine = seen.setdefault((host, token, is_text, path), [0] * 5)
                    digest = _hash(key, count)
                    for k, x in enumerate((1, count, digest & 0xFFFFFFFF, (digest >> 32) & 0xFFFFFFFF, place)):
                        mine[k] += x
            yield _batches(((*k, *v) for k, v in seen.items()), _TOKENS)

    picked = pages.select("host", F.xxhash64(F.col(id_col), F.col(html_col)).alias("key"), F.col(html_col).alias("html"))
    return picked.mapInArrow(rows, _TOKENS)


_PLACES = "host string, key bigint, is_token boolean, lo bigint, hi bigint, letters bigint"


def _places(pages: DataFrame, html_col: str) -> DataFrame:
    """Of each host with a root class (``root``): tokens with their least and last gap;
    paths with depth, kind and letters of slot text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for host, html, root in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("root").to_pylist(), strict=True):
                page, slots = Page(html or ""), []
                for node, token, gap, own in gaps(page, {t: i for i, t in enumerate(root)}):
                    if own:
                        continue
                    if node[1] is not None:
                        slots.append(node)
                    if token is not None:
                        mine = seen.setdefault((host, token, True), [gap, gap, 0])
                        mine[0], mine[1] = min(mine[0], gap), max(mine[1], gap)
                for path, (depth, kind, letters) in page.weights(slots).items():
                    seen.setdefault((host, path, False), [depth, kind, 0])[2] += letters
            yield _batches(((*k, *v) for k, v in seen.items()), _PLACES)

    return pages.select("host", F.col(html_col).alias("html"), "root").mapInArrow(rows, _PLACES)


def _with(pages: DataFrame, hosts: DataFrame, size: F.Column, how: str = "inner") -> DataFrame:
    """``pages`` joined with what is known of their hosts, sent to all if it is small."""
    total = hosts.agg(F.sum(size + F.octet_length("host"))).first()[0] or 0
    return pages.join(F.broadcast(hosts) if total <= BROADCAST_BYTES else hosts, "host", how)


def templates(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """host, root, nested and main of every host with a root class."""
    keys = ["host", "token", "is_text", "path"]
    vectors = tokens(pages, id_col, html_col).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "total", "d1", "d2", "place"))).filter(F.col("n") >= MIN_PAGES)
    vectors = stash(vectors, "vectors")
    vector = ["host", "n", "total", "d1", "d2"]
    classes = vectors.groupBy(*vector).agg(F.count("*").alias("size"), F.count_if(~F.col("is_text")).alias("tags")).filter((F.col("size") >= MIN_TOKENS) & (F.col("tags") > 0))
    first = F.max(F.struct("n", "size", "total", "d1", "d2"))
    chosen = classes.filter("n = total").groupBy("host").agg(first.alias("c")).select("host", "c.n", "c.total", "c.d1", "c.d2")
    order = F.transform(F.array_sort(F.collect_list(F.struct((F.col("place") / F.col("n")).alias("place"), "token"))), lambda t: t["token"])
    roots = stash(vectors.join(chosen, vector).groupBy("host").agg(order.alias("root")), "roots")
    placed = stash(_places(_with(pages, roots, F.size("root") * 8), html_col), "places")
    gap = placed.filter("is_token").groupBy("host", F.col("key").alias("token")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    inside = vectors.join(chosen, vector, "left_anti").join(classes.select(*vector), vector).join(gap, ["host", "token"])
    # a class whose tokens are all in one gap; a text is template inside a tag of its class
    nests = inside.groupBy(*vector).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set(F.when(~F.col("is_text"), F.col("path"))).alias("tags")).filter("lo = hi")
    within = inside.select(*vector, "token", "is_text", "path").join(nests.select(*vector, F.col("lo").alias("gap"), "tags"), vector).filter(~F.col("is_text") | F.array_contains("tags", F.col("path")))
    nested = within.groupBy("host").agg(F.collect_list(F.struct("token", "gap")).alias("nested"))

    letters = placed.filter("NOT is_token").groupBy("host", "key").agg(F.min("lo").alias("depth"), F.min("hi").alias("kind"), F.sum("letters").alias("letters"))
    most = letters.groupBy("host").agg(F.max("letters").alias("most"))
    shares = letters.join(most, "host").withColumn("share", F.col("letters") / F.nullif("most", F.lit(0)))
    good = lambda kind: F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & (F.col("share") >= ARTICLE_SHARE), F.col("key"))))
    deepest = F.max(F.when(F.col("share") >= ELEMENT_SHARE, F.struct("depth", "letters", "key")))
    main = shares.groupBy("host").agg(good(0).alias("a"), good(1).alias("b"), deepest.alias("c"))
    chosen_paths = F.when(F.size("a") > 0, F.col("a")).when(F.size("b") > 0, F.col("b")).when(F.col("c").isNotNull(), F.array("c.key")).otherwise(F.array().cast("array<bigint>"))
    none = F.array().cast("array<struct<token:bigint,gap:bigint>>")
    out = roots.join(nested, "host", "left").join(main.select("host", chosen_paths.alias("main")), "host").select("host", F.struct("root", F.coalesce("nested", none).alias("nested"), "main").alias("template"))
    out = stash(out, "templates")
    discard(vectors, roots, placed)
    return out


@small_batches
def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    hosted = pages.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = templates(hosted, id_col, "html")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, t) for h, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    size = F.size("template.root") * 8 + F.size("template.nested") * 16 + 64
    joined = _with(hosted, found, size, "left").select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), "html", "template")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    out = joined.mapInArrow(rows, f"id {kinds['id']}, url {kinds['url']}, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
    return stash(out.withColumn("n_chars", F.length("text").cast("bigint")), "texts")
