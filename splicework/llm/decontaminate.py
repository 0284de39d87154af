"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` makes a table of shards. A shard covers a few megabytes of texts and
holds, for each of their tokens (as 64-bit hashes, sorted), the ascending list of its
positions; positions leave a gap between documents, so that no phrase crosses one.
``match_phrases`` looks up the terms of the test items in every shard: starting with a
window's rarest term there, its positions, less the term's offset, are intersected with
those of the next rarer term, for all windows at once, until all terms are through. The test windows are the query set: they are sent to the shards in
slices of a checked size, one pass after the other.

Defined cases: a null text has no words; an item without words has no window and one
with fewer words than the window is one window; equal items count each by its id, a
null id as the empty string; repeated rows are judged one by one; empty tables give
empty results (or none hit); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stash
from .textops import LETTER_WORDS, Slice, counts_between, slices

WINDOW = 13
#: A document is contaminated if it has a hit, and at least one hit among so many words.
WORDS_A_HIT = 20
#: Bytes of test text that are sent to the executors at once.
SLICE_OF_ITEMS = 2 << 20

_INDEX = "doc_ids array<bigint>, word_first array<bigint>, terms binary, firsts binary, steps binary, hits binary, found array<struct<doc:int,item:string>>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: documents, their first words, terms and postings."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield _shard(part.column("id"), Slice(texts, True, LETTER_WORDS))

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(shards, _INDEX)


def _shard(ids: pa.Array, words: Slice) -> pa.RecordBatch:
    hashes = words.hashes()
    position = (np.arange(len(hashes)) + words.doc_of_word()).astype(np.uint32)
    order = np.argsort(hashes, kind="stable")
    terms, firsts = np.unique(hashes[order], return_index=True)
    steps = np.diff(position[order], prepend=np.uint32(0))  # modulo 2**32; their running sum gives the positions back
    return pa.RecordBatch.from_pydict(
        {
            "doc_ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
            "word_first": pa.array([words.word_first], pa.list_(pa.int64())),
            "terms": [terms.tobytes()],
            "firsts": [firsts.astype(np.uint32).tobytes()],
            "steps": [steps.tobytes()],
            "hits": pa.array([None], pa.binary()),
            "found": pa.array([[]], pa.list_(pa.struct([("doc", pa.int32()), ("item", pa.string())]))),
        }
    )


class Shard:
    """An index row, opened."""

    def __init__(self, row: pa.RecordBatch):
        value = lambda name, kind: np.frombuffer(row.column(name)[0].as_buffer(), kind)
        self.doc_ids = row.column("doc_ids")[0].values
        self.word_first = row.column("word_first")[0].values.to_numpy()
        self.terms = value("terms", np.uint64)
        self.positions = np.cumsum(value("steps", np.uint32), dtype=np.uint32).astype(np.int64)
        self.firsts = np.append(value("firsts", np.uint32).astype(np.int64), len(self.positions))
        #: (term, position) of all postings as one ascending number.
        self.keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.firsts)) << 32) + self.positions
        n = len(self.doc_ids)
        self.pos_first = self.word_first[:-1] + np.arange(n)
        self.size = int(self.word_first[-1]) + n

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each term its number here, and how many positions it has (0: absent)."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        n = np.where(self.terms[at] == terms, self.firsts[at + 1] - self.firsts[at], 0)
        return at, n

    def among(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Which positions are in the lists of these terms."""
        key = (term << 32) + position
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def posting(self, term: int) -> np.ndarray:
        return self.positions[self.firsts[term] : self.firsts[term + 1]]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pos_first, position, "right") - 1


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one run after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Phrases:
    """The different windows of some items, grouped by length, in terms of a common list
    of terms: each term is looked up once in a shard."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        words = Slice([(t or "").encode() for _, t in items], True, LETTER_WORDS)
        self.names = [name for name, _ in items]
        self.terms, term = np.unique(words.hashes(), return_inverse=True)
        term = term.ravel().astype(np.int32)
        by_len: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i in np.flatnonzero(words.n_words):
            own = term[words.word_first[i] : words.word_first[i + 1]]
            k = min(window, len(own))
            by_len.setdefault(k, []).append((i, np.lib.stride_tricks.sliding_window_view(own, k)))
        #: length: windows, and whose each is (first and number in the list of owners).
        self.sets = {}
        for k, found in by_len.items():
            owner = np.repeat([i for i, _ in found], [len(w) for _, w in found])
            unique, inverse = np.unique(np.concatenate([w for _, w in found]), axis=0, return_inverse=True)
            inverse = inverse.ravel()
            n = np.bincount(inverse, minlength=len(unique))
            self.sets[k] = (unique, owner[np.argsort(inverse, kind="stable")], np.cumsum(n) - n, n)

    def match(self, shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, starts, rows, items) of all windows that occur in the shard: a start
        for each occurrence, and the items of the row-th start. The lists of each window's
        terms, less their offsets, are intersected for all windows at once: the rarest
        term's list first, then what is left of it with the next rarer."""
        number, count = shard.lookup(self.terms)
        for k, (windows, owners, first, many) in self.sets.items():
            of = np.flatnonzero((count[windows] > 0).all(axis=1))
            n = count[windows[of]]
            order = np.argsort(n, axis=1, kind="stable")
            least = n[np.arange(len(of)), order[:, 0]] if len(of) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(of)), least)
            rarest = number[windows[of, order[:, 0]]]
            starts = shard.positions[_spread(shard.firsts[rarest], least)] - order[row, 0]
            for j in range(1, k):
                offset = order[row, j]
                keep = shard.among(number[windows[of[row], offset]], starts + offset) if len(row) else np.zeros(0, bool)
                row, starts = row[keep], starts[keep]
            window = of[row]
            yield k, starts, np.repeat(np.arange(len(starts)), many[window]), owners[_spread(first[window], many[window])]


def _item_slices(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list, bool]]:
    """The test items in slices of about ``most`` bytes of text, and whether a slice is
    the last one."""
    picked = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // most + 1
    for k in range(n):
        yield [tuple(r) for r in (picked if n == 1 else picked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)).collect()], k == n - 1


def match_phrases(index: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", slice_bytes: int = SLICE_OF_ITEMS) -> DataFrame:
    """The index with, in each shard, the words hit by a window (``hits``, a bit for
    each position) and the items found in each document (``found``)."""
    for part, last in _item_slices(items, id_col, text_col, slice_bytes):
        sent = index.sparkSession.sparkContext.broadcast(Phrases(part, window))

        def look(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own in (batch.slice(i, 1) for i in range(len(batch))):
                    shard, phrases = Shard(own), sent.value
                    edge, pairs = np.zeros(shard.size + 1, np.int64), [np.zeros((0, 2), np.int64)]
                    for k, starts, row, items in phrases.match(shard):
                        edge[:-1] += np.bincount(starts, minlength=shard.size)
                        edge -= np.bincount(starts + k, minlength=shard.size + 1)
                        pairs.append(np.stack([shard.doc_of(starts)[row], items], 1))
                    hit = np.cumsum(edge[:-1]) > 0
                    before = own.column("hits")[0]
                    if before.is_valid:
                        hit |= np.unpackbits(np.frombuffer(before.as_buffer(), np.uint8), count=shard.size).astype(bool)
                    found = [{"doc": int(d), "item": phrases.names[o]} for d, o in np.unique(np.concatenate(pairs), axis=0)]
                    new = {"hits": [np.packbits(hit).tobytes()], "found": [own.column("found")[0].as_py() + found]}
                    if last:  # nothing looks them up again
                        new |= {name: [b""] for name in ("terms", "firsts", "steps")}
                    yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else own.column(f.name) for f in own.schema], schema=own.schema)

        index = index.mapInArrow(look, index.schema)
    return index


def document_report(matched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: words, hit words, items found, verdict."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["doc_ids", "word_first", "hits", "found"]).to_pylist():
                n, first = len(row["doc_ids"]), np.array(row["word_first"], np.int64)
                size = int(first[-1]) + n
                hit = np.unpackbits(np.frombuffer(row["hits"] or b"", np.uint8), count=size) if size and row["hits"] else np.zeros(size, np.uint8)
                n_hit = counts_between(hit, np.append(first[:-1] + np.arange(n), size))
                names: dict[int, set] = {}
                for pair in row["found"]:
                    names.setdefault(pair["doc"], set()).add(pair["item"])
                n_words = np.diff(first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(row["doc_ids"], pa.int64()),
                        "n_words": n_words,
                        "n_hit": n_hit,
                        "n_items": pa.array([len(names.get(i, ())) for i in range(n)], pa.int64()),
                        "items_sha256": [hashlib.sha256(",".join(sorted(names.get(i, ()))).encode()).hexdigest() for i in range(n)],
                        "contaminated": (n_hit > 0) & (WORDS_A_HIT * n_hit >= n_words),
                    }
                )

    schema = "id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return matched.mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item): every item all of whose words stand, in any order, among at
    most as many consecutive words of the document as it has, plus ``slop``."""
    out = None
    for part, _ in _item_slices(items, id_col, text_col, SLICE_OF_ITEMS):
        words = Slice([(t or "").encode() for _, t in part], True, LETTER_WORDS)
        hashes = words.hashes()
        wanted = [(name, *np.unique(hashes[words.word_first[i] : words.word_first[i + 1]], return_counts=True), int(words.n_words[i])) for i, (name, _) in enumerate(part) if words.n_words[i]]
        sent = index.sparkSession.sparkContext.broadcast(wanted)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    shard = Shard(batch.slice(i, 1))
                    got = {(int(d), name) for name, terms, need, size in sent.value for d in _near(shard, terms, need, size + slop)}
                    yield pa.RecordBatch.from_pydict({"doc_id": shard.doc_ids.take(pa.array([d for d, _ in sorted(got)], pa.int64())), "item": pa.array([x for _, x in sorted(got)], pa.string())})

        found = index.mapInArrow(look, "doc_id bigint, item string")
        out = found if out is None else out.unionAll(found)
    return out.distinct()


def _near(shard: Shard, terms: np.ndarray, need: np.ndarray, span: int) -> set[int]:
    """Documents with every term as often as needed within ``span`` positions. A span
    that fits starts at some term's position, and holds the need-th next of each."""
    at, n = shard.lookup(terms)
    if (n < need).any():
        return set()
    lists = [shard.posting(t) for t in at]
    rarest = lists[int(np.argmin(n))]
    out = set()
    starts = np.unique(np.concatenate([x[_close(x, rarest, span)] for x in lists]))
    ok = np.ones(len(starts), bool)
    for own, k in zip(lists, need, strict=True):
        last = np.searchsorted(own, starts) + k - 1
        ok &= (last < len(own)) & (own[np.minimum(last, len(own) - 1)] < starts + span)
    doc = shard.doc_of(starts)
    for d, s in zip(doc[ok], starts[ok], strict=True):
        # the span may not reach into the next document
        end = shard.pos_first[d + 1] if d + 1 < len(shard.pos_first) else shard.size
        if all((np.searchsorted(own, min(s + span, end)) - np.searchsorted(own, s)) >= k for own, k in zip(lists, need, strict=True)):
            out.add(int(d))
    return out


def _close(x: np.ndarray, to: np.ndarray, span: int) -> np.ndarray:
    """Which members of ``x`` have a member of ``to`` less than ``span`` after them."""
    nxt = np.searchsorted(to, x)
    return (nxt < len(to)) & (to[np.minimum(nxt, len(to) - 1)] - x < span)


@small_batches
def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """The report of every document of ``docs`` against the test ``items``."""
    index = stash(build_index(docs, id_col), "postings")
    out = stash(document_report(match_phrases(index, items, window), id_col), "report")
    discard(index)
    return out
