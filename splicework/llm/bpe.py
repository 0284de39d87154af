"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Texts are cut into pre-tokens (matches of a pattern). A chunk of texts becomes a
   dictionary of its distinct pre-tokens and, for each position, a dictionary slot.
2. One shuffle deals out both: the dictionaries by word (rows of a bucket of words, its
   words and slots), the positions by chunk. In a bucket each distinct word is encoded
   once for all chunks that have it.
3. The ids are shuffled to their chunks, which meet the positions where these are, and
   each chunk's texts are reassembled by position. Decoding joins ids with the
   token-byte table.

A chunk has at most CHUNK_BYTES of text (or is one longer text), so memory doesn't
follow the input; a word that every text has is one entry in each chunk. Steps 2 and 3
read the same shuffle, so texts are cut once. Where Spark makes its files anew (reuse of
exchanges is off, an executor is lost), the input must give the same rows in the same
order, as files do. A signature of the dictionary is compared where both meet.

Defined cases: a null text is encoded as the empty text: no tokens, and decodes to no
bytes; text is ordinary text, special tokens don't exist; repeated rows give rows each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, small_batches, stash

CHUNK_BYTES = 16 << 20
#: Words up to this many bytes are merged by scanning, longer ones with a heap.
SCANNED_BYTES = 48
AGAIN = "the input gave other rows when it was read again; write it to files first"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged, the leftmost
    first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SCANNED_BYTES:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], 1 << 60) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) < 1 << 60:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over a linked list: n log n steps."""
    n = len(word)
    end = list(range(1, n + 1))  # where the part that starts at i ends; 0: merged away
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        before[stop] = i
        if stop < n and (r := ranks.get(word[i : end[stop]])) is not None:
            heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


class _Slots(dict):
    """Numbers keys from 0 as they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Chunk:
    """Distinct words, the most frequent first, and each position's slot."""

    def __init__(self, texts: list[bytes | None], split: Callable[[str], list[str]]):
        slot = _Slots()
        parts = []
        for t in texts:
            words = split((t or b"").decode())
            parts.append(np.fromiter(map(slot.__getitem__, words), np.uint32, len(words)))
        self.sizes = np.array([len(p) for p in parts], np.int64)
        found = np.concatenate(parts)
        order = np.argsort(-np.bincount(found, minlength=len(slot)), kind="stable")
        rank = np.empty(len(slot), np.uint32)
        rank[order] = np.arange(len(slot), dtype=np.uint32)
        self.slots = rank[found]
        names = list(slot)
        self.words = [names[i].encode() for i in order]
        self.signature = zlib.crc32(b"\0".join(self.words), len(self.slots))


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed by byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _numbered(batches: Iterator[pa.RecordBatch], pattern: str, chunk_bytes: int) -> Iterator[tuple[int, list, Chunk]]:
    import regex

    split = regex.compile(pattern).findall
    k = TaskContext.get().partitionId() << 32
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            n = len(t or b"") + 1
            if ids and held + n > chunk_bytes:
                yield k, ids, Chunk(texts, split)
                k, ids, texts, held = k + 1, [], [], 0
            ids.append(i)
            texts.append(t)
            held += n
    if ids:
        yield k, ids, Chunk(texts, split)


def _chained(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, n of each, one run after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


#: A chunk's positions have a key under 0 (its own) and ids; a bucket's words have the bucket.
_CUT = "key bigint, signature bigint, chunk bigint, ids array<bigint>, sizes binary, slots binary, words binary"
_IDS = "key bigint, signature bigint, slots binary, lengths binary, tokens binary"
_IDS_ARROW = pa.schema([("key", pa.int64()), ("signature", pa.int64()), ("slots", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary())])


def _cut(picked: DataFrame, pattern: str, chunk_bytes: int, buckets: int) -> DataFrame:
    """The chunks' documents and positions, and their dictionaries by bucket of the word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        names = ["key", "signature", "chunk", "ids", "sizes", "slots", "words"]

        def batch(*columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for k, ids, c in _numbered(batches, pattern, chunk_bytes):
            yield batch([-1 - k], [c.signature], [k], [ids], [_pack(c.sizes)], [_pack(c.slots)], [None])
            bucket = np.fromiter(map(zlib.crc32, c.words), np.int64, len(c.words)) % buckets
            order = np.argsort(bucket, kind="stable")
            named, first = np.unique(bucket[order], return_index=True)
            length = np.fromiter(map(len, c.words), np.int64, len(c.words))[order]
            ends = [(a, b) for a, b in zip(first, np.append(first[1:], len(order)), strict=True)]
            words = [pa.compress(b"".join([c.words[i] for i in order[a:b]]), "zstd", asbytes=True) for a, b in ends]
            m = len(named)
            yield batch(named, [c.signature] * m, [k] * m, [None] * m, [_pack(length[a:b]) for a, b in ends], [_pack(order[a:b]) for a, b in ends], words)

    return picked.mapInArrow(rows, _CUT)


def _assembled(docs: DataFrame, ranks: dict[bytes, int], pattern: str, finish: Callable, schema: str, kind: pa.Schema, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """``finish(doc ids, token counts, all tokens)`` of every chunk; ``kind``: its Arrow schema."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(ranks)

    def encode(table: pa.Table) -> pa.Table:
        if table.column("words").null_count:
            return _IDS_ARROW.empty_table()
        sizes = [_unpack(x) for x in table.column("sizes").to_pylist()]
        joined = b"".join(pa.decompress(x, int(n.sum()), "zstd", asbytes=True) for x, n in zip(table.column("words").to_pylist(), sizes, strict=True))
        offsets = np.concatenate([[0], *sizes]).cumsum()
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        own = [encode_word(w, sent.value) for w in words.dictionary.to_pylist()]
        length = np.fromiter(map(len, own), np.int64, len(own))
        first = np.cumsum(length) - length
        flat = np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(length.sum()))
        lengths, tokens = [], []
        for which in np.split(words.indices.to_numpy(), np.cumsum([len(n) for n in sizes])[:-1]):
            lengths.append(_pack(length[which]))
            tokens.append(_pack(flat[_chained(first[which], length[which])]))
        key = pc.subtract(-1, table.column("chunk"))
        return pa.table([key, table.column("signature"), table.column("slots"), pa.array(lengths, pa.binary()), pa.array(tokens, pa.binary())], schema=_IDS_ARROW)

    def assemble(chunk: pa.Table, ids: pa.Table) -> pa.Table:
        if not len(chunk) or chunk.column("words").null_count == 0:
            if len(ids):
                raise ValueError(AGAIN)
            return kind.empty_table()
        (head,) = chunk.to_pylist()
        if set(ids.column("signature").to_pylist()) - {head["signature"]}:
            raise ValueError(AGAIN)
        parts = [(_unpack(r["slots"]), _unpack(r["lengths"]).astype(np.int64), _unpack(r["tokens"])) for r in ids.to_pylist()]
        slots, at = _unpack(head["slots"]), _unpack(head["sizes"]).astype(np.int64)
        length = np.zeros(sum(len(p[0]) for p in parts), np.int64)
        first, base = np.zeros_like(length), 0
        for where, n, tokens in parts:
            length[where], first[where] = n, base + np.cumsum(n) - n
            base += len(tokens)
        table_of = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint32)
        n = length[slots]
        flat = table_of[_chained(first[slots], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return finish(pa.array(head["ids"], pa.int64()), np.diff(total[np.concatenate([[0], np.cumsum(at)])]), flat)

    cut = _cut(picked, pattern, chunk_bytes, buckets_for(picked, "text")).repartition("key").groupBy("key")
    return cut.cogroup(cut.applyInArrow(encode, _IDS).groupBy("key")).applyInArrow(assemble, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id and tokens (array of int) of every row."""

    kind = pa.schema([(id_col, pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def finish(ids: pa.Array, counts: np.ndarray, flat: np.ndarray) -> pa.Table:
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.table([ids, pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))], schema=kind)

    return _assembled(docs, ranks, pattern, finish, f"`{id_col}` bigint, tokens array<int>", kind, id_col, text_col, chunk_bytes)


def token_table(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id; null where no token has it."""
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        out[i] = token
    return pa.array(out, pa.large_binary())


def _joined(flat: np.ndarray, counts: np.ndarray, table: pa.Array) -> list[memoryview]:
    """The bytes of each run of ids: one gather from the token-byte table."""
    got = table.take(pa.array(flat))
    if got.null_count:
        raise ValueError("an id is not in the token table")
    offset = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
    data = memoryview(got.buffers()[2]) if len(got) else memoryview(b"")
    cut = offset[np.concatenate([[0], np.cumsum(counts)])]
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def decode(encoded: DataFrame, ranks: dict[bytes, int], tokens_col: str = "tokens") -> DataFrame:
    """``encoded`` with the column ``decoded`` (binary) in place of the tokens. The
    token table is as large as the vocabulary, whatever the input. Null tokens
    decode to no bytes."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    keep = [c for c in encoded.columns if c != tokens_col]
    schema = encoded.select(*keep, F.lit(b"").alias("decoded")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(sent.value)
        for batch in batches:
            lists = batch.column(tokens_col)
            counts = np.array([0 if x is None else len(x) for x in lists.to_pylist()], np.int64)
            parts = _joined(lists.flatten().to_numpy(zero_copy_only=False), counts, table)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([bytes(p) for p in parts], pa.binary())], [*keep, "decoded"])

    return encoded.mapInArrow(rows, schema)


@small_batches
def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, number of tokens, and digests of the ids and of what they decode to."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def finish(ids: pa.Array, counts: np.ndarray, flat: np.ndarray) -> pa.Table:
        names = np.array([b"%d" % i for i in range(max(sent.value.values()) + 1)], object)
        ends = np.cumsum(counts)
        return pa.table(
            {
                id_col: ids,
                "n_tokens": counts,
                "ids_sha256": [hashlib.sha256(b" ".join(names[flat[b - n : b]])).hexdigest() for b, n in zip(ends, counts, strict=True)],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in _joined(flat, counts, token_table(sent.value))],
            },
            schema=kind,
        )

    return stash(_assembled(docs, ranks, pattern, finish, f"`{id_col}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", kind, id_col, text_col, chunk_bytes), "digests")
