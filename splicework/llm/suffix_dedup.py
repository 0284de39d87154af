"""Removal of byte strings that occur twice, by a multi-document suffix order that is
built column by column.

The order is built in the way of Bauer, Cox and Rosone: in each round every document
gets one symbol more, from its end to its start; the position of the new suffix follows
from the Burrows-Wheeler transform of the suffixes so far (the rank of the symbol
before the place of the document's last suffix), and the transform and the array of
common prefixes are read from files, block by block, and written to new ones in sequence.

To do that on many machines, the texts are first cut by content. Each 400-byte window
has an anchor: the rightmost of its 64-byte strings with the least hash. Equal windows
have equal anchors, so windows whose anchor occurs once in the corpus are done. The
runs of windows of each other anchor, with their bytes, meet by anchor: these segments
are the documents of a build. Its symbols are blocks of 16 bytes, counted from the
anchor. Equal segments are collapsed before they meet: their windows are all repeated,
and one of them stands for all in the build. Windows are equal if the suffixes at their
first whole blocks share 24 blocks by the common prefixes of the order, and the up to 16
bytes before and after these are equal. Anchors with very many occurrences are split
further, by short ranges of windows and the bytes which these have in common; and where
very many segments still differ, as at the edges of one footer, each of their (at most
32) windows is told by its digest, counted over all of them, so that no task gets more
than CROWD segments of one group.

Equal texts are collapsed first: a text of at least 400 bytes that has a copy goes as a
whole, and takes part once.

Defined cases: a null text is empty; texts of under 400 bytes stay as they are; repeated
rows are copies of each other, whatever their ids; an empty table gives an empty
result; other columns are passed on by remove_repeats and ignored by report. A cut may
split a character: remove_repeats drops its bytes.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, small_batches, stash
from .textops import SPACE_WORDS, Slice, mix, slices, span_hashes

LENGTH = 400
GRAM = 64
BLOCK = 16
#: A window of LENGTH bytes holds this many whole blocks, wherever it starts.
WHOLE_BLOCKS = (LENGTH - BLOCK + 1) // BLOCK
#: Anchors with more occurrences are split by ranges of so many windows.
MANY, RANGE = 2000, 32
#: Bytes of text whose anchors are sought, or whose windows are hashed, at once.
ANCHOR_BYTES = 1 << 20
#: A group with more different segments than this isn't built, but told window by window.
CROWD = 4000
#: Blocks in a build, about.
BUILD_BLOCKS = 60_000


#: A column that no document has, and the start of others.
KEY = "__text_key"


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def text_number(key: Column) -> Column:
    """A 64-bit number of the text with this key."""
    return F.xxhash64(key)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    start = np.arange(max(len(data) - GRAM + 1, 0))
    return span_hashes(data, start, start + GRAM)


def anchors(s: Slice) -> tuple[np.ndarray, ...]:
    """Of each anchor in turn: document, position, first and last window (from the
    document's start), and hash."""
    have = s.sizes >= LENGTH
    if not have.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    grams = gram_hashes(s.raw)
    width = LENGTH - GRAM + 1
    low = np.uint64(0xFFFFFFFF)
    # the upper half orders by hash, the lower makes the rightmost of equal ones least
    rank = (mix(grams) & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    rank = np.pad(rank, (0, -len(rank) % width), constant_values=np.iinfo(np.uint64).max).reshape(-1, width)
    upto = np.minimum.accumulate(rank, axis=1).ravel()
    since = np.minimum.accumulate(rank[:, ::-1], axis=1)[:, ::-1].ravel()
    edge = np.zeros(len(s.raw) + 1, np.int8)
    edge[s.first[:-1][have]] += 1
    edge[(s.first[:-1] + s.sizes - LENGTH + 1)[have]] -= 1
    window = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    at = (low - (np.minimum(since[window], upto[window + width - 1]) & low)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)))
    last = np.append(new[1:], len(window)) - 1
    doc = np.searchsorted(s.first, window[new], "right") - 1
    base = s.first[doc]
    return doc, at[new] - base, window[new] - base, window[last] - base, grams[at[new]]


_ANCHORS = "rid bigint, key binary, anchors array<struct<gram:bigint,at:int,lo:int,hi:int>>"


def _anchored(texts: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, "text", ANCHOR_BYTES):
                doc, at, lo, hi, gram = anchors(Slice(raw, False, SPACE_WORDS))
                cut = pa.array(np.searchsorted(doc, np.arange(len(raw) + 1)), pa.int32())
                items = pa.StructArray.from_arrays([pa.array(gram.astype(np.int64)), *(pa.array(x, pa.int32()) for x in (at, lo, hi))], ["gram", "at", "lo", "hi"])
                out = pa.RecordBatch.from_arrays([part.column("rid"), part.column("key"), pa.ListArray.from_arrays(cut, items)], ["rid", "key", "anchors"])
                yield out.filter(pa.array(np.diff(cut.to_numpy()) > 0))

    return texts.mapInArrow(rows, _ANCHORS)


def _pieces(node: int, text: bytes, marks: list[dict]) -> Iterator[tuple]:
    """group, at, node, lo, data: windows lo, lo + 1, ... of a text with their bytes, and
    the anchor's place among them. Equal windows are in segments of one group."""
    for m in marks:
        if not m["many"]:
            yield m["gram"], m["at"] - m["lo"], node, m["lo"], text[m["lo"] : m["hi"] + LENGTH]
            continue
        offset = m["at"] - m["lo"]  # of the first window; windows to the right have less
        while offset >= m["at"] - m["hi"]:
            most = offset // RANGE * RANGE
            least = max(most, m["at"] - m["hi"])
            # what windows with offsets most .. most + RANGE - 1 have in common
            core = text[m["at"] - most : m["at"] - most - RANGE + 1 + LENGTH]
            lo = m["at"] - offset
            name = hashlib.blake2b(core, digest_size=8, salt=most.to_bytes(2, "big")).digest()
            yield int.from_bytes(name, "big", signed=True), offset, node, lo, text[lo : m["at"] - least + LENGTH]
            offset = most - 1


def _pieces_of(batch: pa.RecordBatch) -> Iterator[Iterator[tuple]]:
    """The pieces of 64 texts at a time."""
    for i in range(0, len(batch), 64):
        part = batch.slice(i, 64)
        rows = zip(part.column("node").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("marks").to_pylist(), strict=True)
        yield (x for node, text, marks in rows for x in _pieces(node, text, marks))


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _segments(texts: DataFrame) -> DataFrame:
    """group, at, node, lo, data, n: segments, equal ones of a batch added up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _pieces_of(batch):
                once: dict[tuple, list] = {}
                for group, at, node, lo, data in found:
                    once.setdefault((group, at, data), [node, lo, 0])[2] += 1
                yield _batch([(g, a, node, lo, d, n) for (g, a, d), (node, lo, n) in once.items()], ("group", "at", "node", "lo", "data", "n"), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))

    return texts.mapInArrow(rows, "group bigint, at int, node bigint, lo int, data binary, n bigint")


def _named_segments(texts: DataFrame) -> DataFrame:
    """group, at, name (a digest of the bytes), node, start, end of every segment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _pieces_of(batch):
                named = [(g, a, hashlib.md5(d, usedforsecurity=False).digest(), node, lo, lo + len(d)) for g, a, node, lo, d in found]
                yield _batch(named, ("group", "at", "name", "node", "start", "end"), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32()))

    return texts.mapInArrow(rows, "group bigint, at int, name binary, node bigint, start int, end int")


def _least_between(tables: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value of positions lo to hi (both included), from a table of minima over
    1, 2, 4, ... positions."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), tables[0].dtype)
    for k in np.unique(level):
        i = level == k
        out[i] = np.minimum(tables[k][lo[i]], tables[k][hi[i] - (1 << int(k)) + 1])
    return out


#: More than any common prefix.
_FAR = np.iinfo(np.int32).max


def _minima(x: np.ndarray) -> list[np.ndarray]:
    """Least values over 1, 2, 4, ... positions."""
    out = [x]
    while len(out[-1]) > (step := 1 << (len(out) - 1)):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
    return out


class ColumnwiseOrder:
    """The suffix order of a collection, extended by one symbol a document and round.

    ``bwt`` has the symbol before each suffix (0: not known yet, or none), ``lcp`` the
    symbols that a suffix shares with the one before it, ``suffix`` its name. The three
    are files. A round reads them block by block, once to find the places of the new
    suffixes and what they share with their neighbours, and once to write the next files;
    what it holds is a block, a few numbers a symbol and a few a document. The empty
    suffixes come first, in the documents' order.
    """

    BLOCK = 1 << 16

    def __init__(self, folder: str, n_docs: int, n_symbols: int):
        self.folder, self.n_docs, self.n_symbols, self.round, self.size = folder, n_docs, n_symbols, 0, n_docs
        self.place = np.arange(n_docs)
        self.kinds = (("bwt", np.uint32), ("lcp", np.int32), ("suffix", np.int64))
        self._write((np.zeros(n_docs), np.zeros(n_docs), np.full(n_docs, -1)), "wb")

    def _write(self, arrays: tuple[np.ndarray, ...], mode: str) -> None:
        for (name, kind), x in zip(self.kinds, arrays, strict=True):
            with open(f"{self.folder}/{name}-{self.round}", mode) as f:
                x.astype(kind).tofile(f)

    def blocks(self, round_: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First place, symbols, common prefixes and names, in sequence."""
        r = self.round if round_ is None else round_
        with open(f"{self.folder}/bwt-{r}", "rb") as x, open(f"{self.folder}/lcp-{r}", "rb") as y, open(f"{self.folder}/suffix-{r}", "rb") as z:
            at = 0
            while len(bwt := np.fromfile(x, np.uint32, self.BLOCK)):
                yield at, bwt, np.fromfile(y, np.int32, self.BLOCK), np.fromfile(z, np.int64, self.BLOCK)
                at += len(bwt)

    def _places(self, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """For symbols ``c`` put at the ascending places ``p``: the rank of each, and what
        the new suffix shares with the one before and the one after it that start alike
        (-1: there is none)."""
        count = np.zeros(self.n_symbols + 1, np.int64)
        since = np.full(self.n_symbols + 1, _FAR, np.int64)  # least prefix after a symbol's last place
        before, left, right, open_ = np.zeros(len(p), np.int64), np.full(len(p), -1), np.full(len(p), -1), np.full(len(p), _FAR)
        waiting = np.zeros(0, np.int64)
        for start, bwt, lcp, _ in self.blocks():
            i = np.arange(*np.searchsorted(p, [start, start + len(bwt)]))
            own = p[i] - start
            bwt[own] = c[i]
            n = len(bwt)
            key = np.sort(bwt.astype(np.int64) * n + np.arange(n))
            symbol, place = key // n, key % n
            first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
            last = np.append(first[1:], n) - 1
            named = symbol[first]
            upto = np.minimum.accumulate(lcp)
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1][1:], _FAR)
            # those whose next like symbol is in this block
            run = np.minimum(np.searchsorted(named, c[waiting]), len(named) - 1)
            met = named[run] == c[waiting]
            right[waiting[met]] = np.minimum(open_[waiting[met]], upto[place[first[run[met]]]])
            waiting = waiting[~met]
            open_[waiting] = np.minimum(open_[waiting], upto[-1])
            if len(i):
                minima = _minima(lcp)
                where = np.searchsorted(key, c[i].astype(np.int64) * n + own)
                run = np.searchsorted(named, c[i])
                before[i] = count[c[i]] + where - first[run]
                here = where > first[run]
                left[i[here]] = _least_between(minima, place[where[here] - 1] + 1, own[here])
                far = ~here & (count[c[i]] > 0)
                left[i[far]] = np.minimum(since[c[i[far]]], upto[own[far]])
                here = where < last[run]
                right[i[here]] = _least_between(minima, own[here] + 1, place[where[here] + 1])
                open_[i[~here]] = after[own[~here]]
                waiting = np.append(waiting, i[~here])
            since = np.minimum(since, upto[-1])
            since[named] = after[place[last]]
            count[named] += last - first + 1
        count[0] = 0  # without a symbol there is no suffix yet; the empty ones stand first
        less = np.cumsum(count) - count
        return less[c] + before, np.where(left < 0, -1, left + 1), np.where(right < 0, -1, right + 1)

    def insert(self, docs: np.ndarray, symbols: np.ndarray, names: np.ndarray) -> None:
        """Puts symbols (from 1) in front of the last suffixes of these documents."""
        by = np.argsort(self.place[docs])
        p, c = self.place[docs][by], symbols[by].astype(np.int64)
        rank, left, right = self._places(p, c)
        new = self.n_docs + rank
        order = np.argsort(new)
        old = new[order] - np.arange(len(order))  # the old entry that each stands before
        # the entry after a new one that starts alike: a new one knows it, an old one is told
        told = (right[order] >= 0) & np.append(old[1:] != old[:-1], True)
        values = (np.zeros(len(order)), np.maximum(left[order], 0), names[by][order])
        source, self.round = self.round, self.round + 1
        end = 0
        for start, bwt, lcp, suffix in self.blocks(source):
            end = start + len(bwt)
            i = np.arange(*np.searchsorted(p, [start, end]))
            bwt[p[i] - start] = c[i]
            # new ones behind the last entry belong to the last block
            k = np.arange(*np.searchsorted(old, [start, end if end < self.size else end + 1]))
            t = k[told[k] & (old[k] < end)]
            lcp[old[t] - start] = right[order][t]
            self._write(tuple(np.insert(x, old[k] - start, v[k]) for x, v in zip((bwt, lcp, suffix), values, strict=True)), "ab")
        for name, _ in self.kinds:
            os.unlink(f"{self.folder}/{name}-{source}")
        self.size += len(order)
        self.place = self.place + np.searchsorted(old, self.place, "right")
        self.place[docs[by]] = new


def _ordered(folder: str, blocks: list[np.ndarray]) -> ColumnwiseOrder:
    """The order of all suffixes of these documents, named by their place in all blocks."""
    size = np.array([len(b) for b in blocks])
    first = np.cumsum(size) - size
    alphabet, symbol = np.unique(np.concatenate(blocks), return_inverse=True)
    symbol = symbol.ravel() + 1
    order = ColumnwiseOrder(folder, len(blocks), len(alphabet))
    for r in range(int(size.max(initial=0))):
        docs = np.flatnonzero(size > r)
        name = first[docs] + size[docs] - 1 - r
        order.insert(docs, symbol[name], name)
    return order


def common_blocks(blocks: list[np.ndarray]) -> np.ndarray:
    """For each block of each document, in turn: the most blocks that the suffix from
    it on has in common with another suffix."""
    out = np.zeros(sum(map(len, blocks)), np.int64)
    with tempfile.TemporaryDirectory() as folder:
        name = -1
        for _, _, lcp, suffix in _ordered(folder, blocks).blocks():
            for shared, own in zip(lcp.tolist(), suffix.tolist(), strict=True):
                for x in {name, own} - {-1}:
                    out[x] = max(out[x], shared)
                name = own
    return out


def alike(blocks: list[np.ndarray], least: int) -> np.ndarray:
    """For each block of each document, in turn: a number that suffixes share if they
    begin with the same ``least`` blocks; -1 where no other one does."""
    out = np.full(sum(map(len, blocks)), -1)
    with tempfile.TemporaryDirectory() as folder:
        run = 0
        for _, _, lcp, suffix in _ordered(folder, blocks).blocks():
            group = run + np.cumsum(lcp < least)
            run = int(group[-1])
            out[suffix[suffix >= 0]] = group[suffix >= 0]
    _, inverse, n = np.unique(out, return_inverse=True, return_counts=True)
    return np.where(n[inverse] > 1, out, -1)


def _words_at(joined: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BLOCK bytes from each start on, as two numbers."""
    both = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(joined, BLOCK)[start]).view("<u8") if len(start) else np.zeros((0, 2), np.uint64)
    return both[:, 0], both[:, 1]


def _numbered(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's value, and how many rows each number has."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for x in columns:
        new[1:] |= x[order][1:] != x[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    return number, np.bincount(number)


def repeated_windows(data: list[bytes], at: np.ndarray) -> np.ndarray:
    """(segment, window) of the windows that two places of these segments have. Equal
    windows have their anchor at one place, so their whole blocks are equal suffixes'
    beginnings; what stands before and after these, a block together, is compared."""
    joined = np.frombuffer(b"".join(data), np.uint8)
    size = np.array([len(d) for d in data])
    first = np.cumsum(size) - size
    skip = at % BLOCK  # bytes before the first block
    count = (size - skip) // BLOCK
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    of = np.repeat(np.arange(len(data)), count)
    symbol, _ = _numbered(_words_at(joined, first[of] + skip[of] + BLOCK * number))
    group = alike(np.split(symbol, np.cumsum(count)[:-1]), WHOLE_BLOCKS)
    good = np.flatnonzero(group >= 0)
    found = []
    for k in range(BLOCK):  # bytes of the window before its first whole block
        window = skip[of[good]] + BLOCK * number[good] - k
        ok = (window >= 0) & (window <= size[of[good]] - LENGTH)
        segment, window, own = of[good][ok], window[ok], group[good][ok]
        start = first[segment] + window
        head, tail = start[:, None] + np.arange(k), start[:, None] + WHOLE_BLOCKS * BLOCK + np.arange(k, BLOCK)
        ends = np.ascontiguousarray(joined[np.concatenate([head, tail], axis=1)]).view("<u8")
        # where the anchor stands decides nothing more: it is at one place of equal windows
        same, n = _numbered((ends[:, 0], ends[:, 1], own, (at[segment] - window)))
        twice = n[same] > 1 if len(same) else np.zeros(0, bool)
        found.append(np.stack([segment[twice], window[twice]], 1))
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _spans(texts: DataFrame, buckets: int) -> DataFrame:
    """(node, spans) of ``texts`` (node, text, marks): repeated bytes, run by run in
    order; runs may overlap."""

    def build(table: pa.Table) -> pa.Table:
        node, at, lo, n = (table.column(c).to_numpy() for c in ("node", "at", "lo", "n"))
        found = repeated_windows(table.column("data").to_pylist(), at.astype(np.int64))
        found = found[n[found[:, 0]] == 1]  # of collapsed ones all is repeated
        segment, window = found[:, 0], found[:, 1]
        new = np.append(True, (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1))[: len(found)]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(found))[: len(head)] - 1
        own = segment[head]
        return pa.table({"node": node[own], "start": (lo[own] + window[head]).astype(np.int32), "end": (lo[own] + window[tail] + LENGTH).astype(np.int32)})

    bucket = F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int")
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of a segment, by a digest."""
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                rows = [
                    (r["group"], r["at"] - i, hashlib.md5(r["data"][i : i + LENGTH], usedforsecurity=False).digest(), r["node"], r["lo"] + i, r["n"])
                    for r in part.select(["group", "at", "data", "node", "lo", "n"]).to_pylist()
                    for i in range(len(r["data"]) - LENGTH + 1)
                ]
                yield _batch(rows, ("group", "at", "name", "node", "start", "n"), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()))

    dealt = _segments(texts).withColumn("bucket", bucket).repartition("bucket")
    once = stash(dealt.groupBy("bucket", "group", "at", "data").agg(F.sum("n").alias("n"), F.min("node").alias("node"), F.min("lo").alias("lo")), "segments")
    crowded = stash(once.groupBy("group").agg(F.count("*").alias("k")).filter(F.col("k") > CROWD).select("group"), "crowded")
    alone = stash(once.join(crowded, "group", "left_anti").select("bucket", "node", "at", "lo", "data", "n").groupBy("bucket").applyInArrow(build, "node bigint, start int, end int"), "alone")
    each = stash(once.join(crowded, "group", "left_semi").mapInArrow(windows, "group bigint, at int, name binary, node bigint, start int, n bigint"), "windows")
    twice = each.groupBy("group", "at", "name").agg(F.sum("n").alias("k")).filter("k > 1").select("group", "at", "name")
    apart = stash(each.filter("n = 1").join(twice, ["group", "at", "name"], "left_semi").select("node", "start", (F.col("start") + LENGTH).alias("end")), "apart")
    discard(crowded, each)
    several = stash(once.filter("n > 1").select("group", "at", F.unhex(F.md5("data")).alias("name")), "collapsed")
    discard(once)
    copies = _named_segments(texts).join(several, ["group", "at", "name"], "left_semi").select("node", "start", "end")
    spans = alone.unionAll(apart).unionAll(copies).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    out = stash(spans, "spans")
    discard(alone, apart, several)
    return out


class Repeats(NamedTuple):
    """What is repeated in some documents: ``rows`` (id, key, n_bytes), ``texts`` (key,
    n: rows that have the text, node), ``spans`` (node, spans), and ``held``, the texts
    that may have spans (node, text)."""

    rows: DataFrame
    texts: DataFrame
    spans: DataFrame
    held: DataFrame


def repeats(docs: DataFrame, id_col: str, text_col: str) -> Repeats:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rid = F.coalesce(F.col(id_col).cast("bigint"), F.lit(0))
    rows = stash(docs.select(F.col(id_col).cast("bigint").alias("id"), text_key(F.col(text_col)).alias("key"), F.octet_length(text).cast("bigint").alias("n_bytes")), "rows")
    some = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.coalesce("id", F.lit(0))).alias("rid"))
    texts = stash(some.withColumn("node", F.monotonically_increasing_id()), "texts")
    source = docs.select(rid.alias("rid"), text_key(F.col(text_col)).alias("key"), text.alias("text")).filter(F.octet_length("text") >= LENGTH)
    marked_texts = stash(_anchored(source), "anchored")
    anchored = marked_texts.join(texts.select("rid", "key", "node"), ["rid", "key"])
    each = anchored.select("node", F.explode("anchors").alias("m")).select("node", "m.*")
    often = stash(each.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    marks = F.collect_list(F.struct("gram", "at", "lo", "hi", (F.col("n") > MANY).alias("many")))
    marked = stash(each.join(often, "gram").groupBy("node").agg(marks.alias("marks")), "marked")
    discard(marked_texts, often)
    wanted = marked.join(texts.select("node", "rid", "key"), "node")
    held = stash(source.join(wanted, ["rid", "key"]).select("node", "text", "marks"), "held")
    n = marked.agg(F.sum(F.size("marks"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), n * (LENGTH + 175) // BLOCK // BUILD_BLOCKS + 1)
    spans = _spans(held, buckets)
    discard(marked)
    return Repeats(rows, texts, spans, held)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


@small_batches
def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: DataFrame | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, the digest of what is kept and whether anything was
    removed, of every row; and has_passages, whether ``also`` (row: ``text_number``, each
    once) names its text."""
    r = repeats(docs, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for node, text, spans in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                cut = merged(spans)
                got.append((node, sum(b - a for a, b in cut), len(cut), hashlib.sha256(without(text.encode(), cut)).hexdigest()))
            cols = list(zip(*got, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "removed", "spans", "sha"])

    cut = r.held.select("node", "text").join(r.spans, "node").mapInArrow(rows, "node bigint, removed bigint, spans bigint, sha string").dropDuplicates(["node"])
    cut = stash(cut, "cuts")
    discard(r.held, r.spans)
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= LENGTH)
    known = r.texts.join(cut, "node", "left").select("key", "n", "removed", "spans", "sha")
    more = []
    if also is not None:
        named = also.select(F.col("row"), F.lit(True).alias("named"))
        known = known.join(named, text_number(F.col("key")) == F.col("row"), "left")
        more = [F.coalesce("named", F.lit(False)).alias("has_passages")]
    return r.rows.join(known, "key").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("key")))).alias("kept_sha256"),
        (whole | F.coalesce(F.col("removed") > 0, F.lit(False))).alias("has_repeats"),
        *more,
    )


@small_batches
def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: DataFrame | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut from the texts (nulls stay null), and the bytes
    that ``also`` (row, spans: sorted) names for the rows of some ids."""
    r = repeats(docs, id_col, text_col)
    discard(r.held, r.rows)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or s is None else without(t.encode(), merged(s)).decode(errors="ignore"))

    known = r.texts.join(r.spans, "node", "left").filter("n > 1 OR spans IS NOT NULL").select(F.col("key").alias(KEY), F.col("n").alias(f"{KEY}_n"), F.col("spans").alias(f"{KEY}_spans"))
    joined = docs.withColumn(KEY, text_key(F.col(text_col))).join(known, KEY, "left")
    if also is not None:
        more = also.select(F.col("row").alias(f"{KEY}_row"), F.col("spans").alias(f"{KEY}_also"))
        joined = joined.join(more, F.col(id_col).cast("bigint") == F.col(f"{KEY}_row"), "left")
        own, other = F.col(f"{KEY}_spans"), F.col(f"{KEY}_also")
        joined = joined.withColumn(f"{KEY}_spans", F.coalesce(F.array_sort(F.concat(own, other)), own, other))
    whole = (F.col(f"{KEY}_n") > 1) & (F.octet_length(text_col) >= LENGTH)
    out = joined.withColumn(text_col, F.when(whole, F.lit("")).when(F.col(f"{KEY}_spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(f"{KEY}_spans")))).select(*docs.columns)
    out = stash(out, "without-repeats")
    discard(r.texts, r.spans)
    return out
