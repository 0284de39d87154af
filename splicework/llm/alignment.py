"""Alignment of two tokenizers over the same bytes by interval coalescing.

The tokens of both tokenizers are intervals of bytes. A slice of texts is worked on at
once: all intervals are sorted by start (lexsort), the running maximum of their ends is
taken (maximum.accumulate), and a group breaks where a start reaches that maximum, which
is where tokens of both end. Within a group the overlaps are expanded to links.

How many documents link a pair of ids is a count over the corpus:

1. A chunk of texts becomes a dictionary of its distinct pairs, each with the number of
   its documents that link it, and for each document its slots and multiplicities. It is
   written, as tokenizing is what costs.
2. The dictionaries are added up by pair, and the highest count of each A id is taken
   (one row for each entry of A's vocabulary, so it is broadcast).
3. Counts are joined back to the dictionaries and each chunk's documents are added up.
   A pair is one row of a chunk, however often it occurs there.

A is a byte-level BPE file (JSON), B a piece model with byte fallback; both are sent as
bytes. A chunk has at most CHUNK_BYTES of text (or is one longer text).

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from
space+text, have no tokens: zeros and an empty digest; strings of special tokens are plain
text; repeated rows give rows each and each counts as a document; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _pack, _unpack
from .common import small_batches, stash

CHUNK_BYTES = 8 << 20
#: Bytes of text that are aligned at once.
SLICE_BYTES = 1 << 20
#: Texts with a longer run without (or of) white space go to the slower encoder, whose
#: time doesn't grow with the square of a run.
LONGEST_RUN = 1000
#: UTF-8 lead bytes of letters that are old enough to be letters in every library.
_SETTLED = np.ones(256, bool)
_SETTLED[[0xE0, 0xE1, 0xEA, 0xEF, *range(0xF0, 0x100)]] = False
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1
    characters stand for themselves, all others for 256 onwards."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def a_token_bytes(text: str) -> list[bytes | None]:
    """The bytes of each A id; None for special tokens and gaps."""
    model, char = json.loads(text), byte_of_char()
    special = {x["id"] for x in model["added_tokens"]}
    vocabulary = model["model"]["vocab"]
    out: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if i not in special:
            out[i] = bytes(char[c] for c in token)
    return out


def b_token_bytes(model: bytes) -> list[bytes]:
    """The bytes of each B id: pieces in UTF-8 with U+2581 as space, <0xHH> as its byte."""
    from sentencepiece import SentencePieceProcessor

    b = SentencePieceProcessor(model_proto=model)
    return [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]


class Encoders:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes, pattern: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.slow_a = Tokenizer.from_str(a_json.decode())
        self.slow_a.encode_special_tokens = True
        a, b = a_token_bytes(a_json.decode()), b_token_bytes(b_model)
        self.quick_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={x: i for i, x in enumerate(a) if x is not None}, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=b_model)
        self.a_bytes, self.b_bytes = pa.array([x or b"" for x in a], pa.large_binary()), pa.array(b, pa.large_binary())
        self.a_size, self.b_size = (np.array([len(x or b"") for x in t], np.int64) for t in (a, b))
        self.n_a, self.n_b = len(a), len(b)
        #: Every id's decimal name, followed by each separator.
        self.names = pa.array([f"{i}{s}" for s in (",", "|", ";", "") for n in (self.n_a, self.n_b) for i in range(n)], pa.large_binary())

    def encode_a(self, text: str, raw: bytes) -> np.ndarray:
        """Ids of a text that starts with its space."""
        data = np.frombuffer(raw, np.uint8)
        edges = np.flatnonzero(np.diff(_BLANK[data], prepend=~_BLANK[data[0]], append=~_BLANK[data[-1]]))
        if _SETTLED[data].all() and np.diff(edges).max() <= LONGEST_RUN:
            return self.quick_a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.slow_a.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, text: str) -> np.ndarray:
        """Ids of a text without its space, which B adds."""
        return np.array(self.b.encode(text, num_threads=1), np.int64)


@functools.cache
def _encoders(a_json: bytes, b_model: bytes, pattern: str) -> Encoders:
    return Encoders(a_json, b_model, pattern)


def _gather(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of the joined entries."""
    if not len(ids):
        return np.zeros(1, np.int64), memoryview(b"")
    got = table.take(pa.array(ids))
    offset = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
    return offset - offset[0], memoryview(got.buffers()[2]).cast("B")[offset[0] : offset[-1]]


class Aligned(NamedTuple):
    """Tokens, groups and links of some texts; ``*_first`` bound each text's part."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_first: np.ndarray
    link_a: np.ndarray  # places in a
    link_b: np.ndarray
    link_first: np.ndarray


def _firsts(counts: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each A and each B interval, and where each group starts. Intervals of
    one kind don't overlap one another, and aren't empty."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)), start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.concatenate([[True], start[order][1:] >= reach[:-1]])[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a_start)], group[len(a_start) :], start[order][breaks]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in A, place in B) whose intervals share a byte."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)


def align_texts(texts: list[str | None], e: Encoders) -> Aligned:
    """Tokens, groups and links of texts; equal texts are encoded once."""
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    none = np.zeros(0, np.int64)
    ids, sizes = [], []
    for t in texts:
        if not t:
            ids.append((none, none))
            sizes.append(0)
            continue
        if t not in known:
            raw = b" " + t.encode()
            a, b = e.encode_a(" " + t, raw), e.encode_b(t)
            same = _gather(e.a_bytes, a)[1] == raw and _gather(e.b_bytes, b)[1] == raw
            known[t] = (a, b, len(raw)) if same else (none, none, 0)
        a, b, n = known[t]
        ids.append((a, b))
        sizes.append(n)
    first = _firsts(sizes)
    a, b = (np.concatenate([x[k] for x in ids]) if ids else none for k in (0, 1))
    a_end, b_end = np.cumsum(e.a_size[a]), np.cumsum(e.b_size[b])
    a_start, b_start = a_end - e.a_size[a], b_end - e.b_size[b]
    a_group, b_group, group_start = coalesce(a_start, a_end, b_start, b_end)
    link_a, link_b = overlaps(a_start, a_end, b_start, b_end)
    a_first, b_first = (_firsts([len(x[k]) for x in ids]) for k in (0, 1))
    return Aligned(a, b, a_first, b_first, a_group, b_group, np.searchsorted(group_start, first), link_a, link_b, np.searchsorted(link_a, a_first))


def group_digests(x: Aligned, e: Encoders) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3` of each text; empty without tokens."""
    part = np.concatenate([2 * x.a_group, 2 * x.b_group + 1])
    order = np.argsort(part, kind="stable")
    part, name = part[order], np.concatenate([x.a, e.n_a + x.b])[order]
    sep = np.zeros(len(part), np.int64)
    sep[:-1] = np.where(part[1:] == part[:-1], 0, np.where(part[1:] // 2 == part[:-1] // 2, 1, 2))
    token_first = np.searchsorted(part, 2 * x.group_first)
    sep[token_first[1:][np.diff(token_first) > 0] - 1] = 3
    offset, data = _gather(e.names, sep * (e.n_a + e.n_b) + name)
    return [hashlib.sha256(data[offset[i] : offset[j]]).hexdigest() if j > i else "" for i, j in zip(token_first[:-1], token_first[1:], strict=True)]


def distinct_pairs(x: Aligned, e: Encoders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, multiplicities, how many each text has): the distinct linked pairs of each
    text; a pair is A id * 2^32 + B id."""
    doc = np.repeat(np.arange(len(x.link_first) - 1), np.diff(x.link_first))
    dense = e.n_a * e.n_b
    key, times = np.unique(doc * dense + x.a[x.link_a] * e.n_b + x.b[x.link_b], return_counts=True)
    pair = key % dense
    return (pair // e.n_b << 32) + pair % e.n_b, times, np.bincount(key // dense, minlength=len(x.link_first) - 1)


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str | None]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            n = len(t or "") + 1
            if ids and held + n > most:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += n
    if ids:
        yield ids, texts


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def groups(docs: DataFrame, a_json: bytes, b_model: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``groups``: for every group its first byte in space+text, its A ids and its B ids."""
    sent = docs.sparkSession.sparkContext.broadcast((a_json, b_model, pattern))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoders(*sent.value)
        for ids, texts in _slices(batches, SLICE_BYTES):
            x = align_texts(texts, e)
            n = int(x.group_first[-1])
            a_first, b_first = (np.searchsorted(g, np.arange(n + 1)) for g in (x.a_group, x.b_group))
            start = np.append(0, np.cumsum(e.a_size[x.a]))[a_first[:-1]]
            own = start - np.repeat(start[np.minimum(x.group_first[:-1], n - 1)] if n else start, np.diff(x.group_first))
            made = [pa.array(own), *(pa.ListArray.from_arrays(pa.array(f, pa.int32()), pa.array(v, pa.int32())) for f, v in ((a_first, x.a), (b_first, x.b)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(x.group_first, pa.int32()), pa.StructArray.from_arrays(made, ["start", "a", "b"]))], [id_col, "groups"])

    return _picked(docs, id_col, text_col).mapInArrow(rows, f"`{id_col}` bigint, groups array<struct<start: bigint, a: array<int>, b: array<int>>>")


_CHUNK = "chunk bigint, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, sizes binary, slots binary, times binary, pairs array<bigint>, seen array<int>"


def _chunks(docs: DataFrame, a_json: bytes, b_model: bytes, pattern: str, id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((a_json, b_model, pattern))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoders(*sent.value)
        k, held, parts = TaskContext.get().partitionId() << 32, 0, []
        for ids, texts in _slices(batches, SLICE_BYTES):
            n = sum(len(t or "") for t in texts)
            if parts and held + n > CHUNK_BYTES:
                yield chunk_row(k, parts)
                k, held, parts = k + 1, 0, []
            held += n
            x = align_texts(texts, e)
            parts.append((ids, *(np.diff(f) for f in (x.a_first, x.b_first, x.group_first, x.link_first)), group_digests(x, e), *distinct_pairs(x, e)))
        if parts:
            yield chunk_row(k, parts)

    def chunk_row(k: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, *counts, digests, pairs, times, sizes = zip(*parts, strict=True)
        own, slots, seen = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
        lists = [pa.array([np.concatenate(c)], pa.list_(pa.int64())) for c in counts]
        return pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int64()), pa.array([[i for p in ids for i in p]], pa.list_(pa.int64())), *lists, pa.array([[d for p in digests for d in p]], pa.list_(pa.string())), *(pa.array([_pack(v)], pa.binary()) for v in (np.concatenate(sizes), slots, np.concatenate(times))), pa.array([own], pa.list_(pa.int64())), pa.array([seen.astype(np.int32)], pa.list_(pa.int32()))],
            [c.split()[0] for c in _CHUNK.split(", ")],
        )

    return _picked(docs, id_col, text_col).mapInArrow(rows, _CHUNK)


def _entries(chunks: DataFrame) -> DataFrame:
    """(chunk, slot, pair, documents of the chunk that link it)."""
    return chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "seen")).alias("slot", "x")).select("chunk", "slot", F.col("x.pairs").alias("pair"), F.col("x.seen").alias("seen"))


def _rated(chunks: DataFrame) -> DataFrame:
    """(pair, its count, whether that is its A id's highest)."""
    counts = stash(_entries(chunks).groupBy("pair").agg(F.sum("seen").alias("n")).withColumn("a", F.shiftright("pair", 32).cast("int")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most as many rows as A's vocabulary
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


@small_batches
def link_counts(docs: DataFrame, a_json: bytes, b_model: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs, best): every linked pair of ids, the documents that link it, and
    whether no other pair of its A id has more."""
    found = _rated(stash(_chunks(docs, a_json, b_model, pattern, id_col, text_col), "aligned"))
    return found.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), F.col("n").alias("n_docs"), "best")


@small_batches
def digests(docs: DataFrame, a_json: bytes, b_model: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of tokens, groups and links, how many links are their A id's best, the
    sum of their pairs' counts, and a digest of the groups."""
    chunks = stash(_chunks(docs, a_json, b_model, pattern, id_col, text_col), "aligned")
    rated = _entries(chunks).select("chunk", "slot", "pair").join(_rated(chunks), "pair").select(F.col("chunk").alias("of"), "slot", "n", "best")

    def finish(key: tuple, heads: pa.Table, found: pa.Table) -> pa.Table:
        head = heads.to_pylist()[0]
        slots, times, sizes = (_unpack(head[c]).astype(np.int64) for c in ("slots", "times", "sizes"))
        n, best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        at = found.column("slot").to_numpy()
        n[at], best[at] = found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        first = _firsts(sizes)
        n_best, count_sum = (np.diff(_firsts(times * v[slots])[first]) for v in (best, n))
        return pa.table({id_col: pa.array(head["ids"], pa.int64())} | {c: pa.array(head[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"n_best": n_best, "count_sum": count_sum, "groups_sha256": head["groups_sha256"]})

    heads = chunks.drop("pairs", "seen")
    schema = f"`{id_col}` bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return stash(heads.groupBy("chunk").cogroup(rated.groupBy("of")).applyInArrow(finish, schema), "alignment")
