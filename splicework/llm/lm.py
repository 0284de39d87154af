"""An interpolated modified Kneser-Ney bigram model: counted in Spark, stored as
sorted hash arrays, memory-mapped by the workers that score.

Counting: tasks count the tokens and bigrams of their texts as 64-bit hashes, and send
them to the bucket of the pair, so that very common contexts are dealt out too; buckets
grow in number with the text. A bucket adds up its pairs, writes one file of the model and
sends on what they add to each context, and how many contexts each word follows; the
buckets of contexts and words add those up and write their files. A file
is a few sorted arrays (keys, then values), and a lookup is a binary search in its
mapping, so a worker holds only the pages that it touches.

Probability of w after u, with the discounts D1, D2, D3+ of Chen and Goodman:
    p(w|u) = max(c(uw) - D(c), 0) / c(u.) + g(u) * q(w)
    q(w)   = max(n(.w) - E(n), 0) / n(..) + h * 1 / (V + 1)
g and h give what the discounts took; n counts contexts. A text is scored from the
begin mark to the end token. Words that were never seen share the 1 / (V + 1).

Files are written and read through the shared folder: directly where it is a mounted
path, else through pyarrow's file systems with a copy beside the worker for mapping.

Defined cases: a null text is the empty text (one token: the end); a null id counts as
the empty string, which trains; without training tokens q is 1 / (V + 1); repeated rows
all count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import sys
import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, discard, new_path, small_batches, stash
from .textops import SPACE_WORDS, Slice, pair_hash, slices

FOLDS, HELD_FOLD = 5, 1
#: Fixed marks: no word hashes to them but by chance of 2**-64.
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Tokens that a counting task holds before it sends their counts.
HELD_TOKENS = 2 << 20
#: A mapping needs no open file beside it, where Python lets it go without.
_NO_FILE = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def sequence(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of every bigram, the begin mark and the end token included,
    and where each text's bigrams begin (and the last ends)."""
    s = Slice(texts, True, SPACE_WORDS)
    first = s.word_first + np.arange(len(s) + 1)
    word = np.full(first[-1], END, np.uint64)
    inside = np.ones(len(word), bool)
    inside[first[1:] - 1] = False
    word[inside] = s.hashes()
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first[:-1]] = BEGIN
    return context, word, first


def _summed(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (context, word) pairs added up, in order of context and word."""
    order = np.lexsort((word, context))
    context, word, count = context[order], word[order], count[order]
    new = np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))[: len(word)]
    at = np.flatnonzero(new)
    return context[at], word[at], np.add.reduceat(count, at) if len(at) else count


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and its length."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return at, np.diff(np.append(at, len(x)))


def _sent(context: np.ndarray, word: np.ndarray, count: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Pairs by bucket of the pair, as one context may have a great share of all: contexts
    once each, their sizes, words, counts."""
    to = _bucket(pair_hash(context, word), buckets)
    order = np.argsort(to, kind="stable")
    to, context, word, count = (x[order] for x in (to, context, word, count))
    at, size = _runs(to)
    rows = []
    for a, n in zip(at, size, strict=True):
        own = slice(a, a + n)
        run, length = _runs(context[own])
        packed = pa.compress(np.concatenate([length.astype(np.uint32), count[own].astype(np.uint32)]).tobytes(), "zstd", asbytes=True)
        rows.append((int(to[a]), len(run), int(n), context[own][run].tobytes(), word[own].tobytes(), packed))
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "n_contexts", "n", "contexts", "words", "counts"])


_PAIRS = "bucket int, n_contexts int, n int, contexts binary, words binary, counts binary"


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for r in table.to_pylist():
        k, n = r["n_contexts"], r["n"]
        both = np.frombuffer(pa.decompress(r["counts"], 4 * (k + n), "zstd", asbytes=True), np.uint32)
        parts.append((np.repeat(np.frombuffer(r["contexts"], np.uint64), both[:k]), np.frombuffer(r["words"], np.uint64), both[k:].astype(np.int64)))
    return _summed(*(np.concatenate([p[i] for p in parts]) for i in range(3)))


def _count_pairs(train: DataFrame, buckets: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            context, word = (np.concatenate([h[i] for h in held]) for i in range(2))
            return _sent(*_summed(context, word, np.ones(len(word), np.int64)), buckets)

        for batch in batches:
            for _, texts in slices(batch, "text"):
                context, word, _ = sequence(texts)
                held.append((context, word))
                n += len(word)
                if n >= HELD_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return train.select(F.col("text")).mapInArrow(rows, _PAIRS)


class Store:
    """The model's folder: arrays under names, each name one file."""

    def __init__(self, url: str):
        self.url = url
        parsed = urlparse(url)
        self.local = parsed.path if parsed.scheme in ("", "file") else None

    def _remote(self, name: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.url}/{name}")

    def write(self, name: str, **arrays: np.ndarray) -> None:
        """Under a name of this attempt first, so that a repeated task does no harm."""
        head = b"".join(f"{k}:{v.dtype.str}:{len(v)};".encode() for k, v in arrays.items()).ljust(512)
        if self.local is None:
            system, path = self._remote(name)
            with system.open_output_stream(path) as f:
                f.write(head)
                for v in arrays.values():
                    f.write(v.tobytes())
            return
        os.makedirs(self.local, exist_ok=True)
        fd, temp = tempfile.mkstemp(dir=self.local, prefix=".part-")
        with os.fdopen(fd, "wb") as f:
            f.write(head)
            for v in arrays.values():
                f.write(np.ascontiguousarray(v))
        os.replace(temp, f"{self.local}/{name}")

    def map(self, name: str) -> dict[str, np.ndarray]:
        if self.local is None:
            system, path = self._remote(name)
            own = tempfile.TemporaryFile()
            with system.open_input_stream(path) as f:
                while block := f.read(1 << 20):
                    own.write(block)
            own.flush()
            mapped = mmap.mmap(own.fileno(), 0, access=mmap.ACCESS_READ, **_NO_FILE)
        else:
            with open(f"{self.local}/{name}", "rb") as f:
                mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_NO_FILE)
        out, at = {}, 512
        for item in mapped[:512].decode().strip().split(";")[:-1]:
            k, kind, n = item.split(":")
            out[k] = np.frombuffer(mapped, np.dtype(kind), int(n), at)
            at += out[k].nbytes
        return out


_SUMS = "bucket int, of_words boolean, keys binary, numbers binary, f1 bigint, f2 bigint, f3 bigint, f4 bigint"
_WORDS = "f1 bigint, f2 bigint, f3 bigint, f4 bigint, total bigint, tokens bigint, types bigint"


def _partial(of_words: bool, key: np.ndarray, numbers: list[np.ndarray], buckets: int) -> list[tuple]:
    """Sums by key, in order of the key, as a row for each bucket of keys."""
    cut, n = _runs(_bucket(key, buckets))
    packed = lambda o: pa.compress(np.stack([x[o] for x in numbers]).astype(np.uint64).tobytes(), "zstd", asbytes=True)
    return [(int(_bucket(key[a : a + 1], buckets)[0]), of_words, key[a : a + k].tobytes(), packed(slice(a, a + k))) for a, k in zip(cut, n, strict=True)]


def _added(rows: list[dict], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys of such rows, in order, and their numbers added up."""
    parts = [np.zeros((width + 1, 0), np.uint64)]
    for r in rows:
        key = np.frombuffer(r["keys"], np.uint64)
        parts.append(np.vstack([key, np.frombuffer(pa.decompress(r["numbers"], 8 * width * len(key), "zstd", asbytes=True), np.uint64).reshape(width, -1)]))
    every = np.concatenate(parts, axis=1)
    every = every[:, np.argsort(every[0], kind="stable")]
    at, _ = _runs(every[0])
    return every[0][at], [np.add.reduceat(x.astype(np.int64), at) if len(at) else x.astype(np.int64) for x in every[1:]]


def _frequencies(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def discounts(f: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many counts are 1, 2, 3 and 4. Where too few are, as in
    tiny corpora, a discount is 0.75."""
    y = f[0] / (f[0] + 2 * f[1]) if f[0] and f[1] else 0
    got = [k - (k + 1) * y * f[k] / f[k - 1] if y and f[k - 1] else 0.75 for k in (1, 2, 3)]
    return tuple(d if 0 < d <= k else 0.75 for k, d in zip((1, 2, 3), got, strict=True))


@small_batches
def train(docs: DataFrame, url: str, buckets: int) -> dict:
    """Counts the model of ``docs`` (text) into the folder ``url``; its few totals."""
    store = Store(url)

    def pairs_of(table: pa.Table) -> pa.Table:
        """Writes a bucket of pairs; sends on the sums of its contexts, and how many
        contexts each word has here."""
        context, word, count = _received(table)
        key = pair_hash(context, word)
        order = np.argsort(key)
        store.write(f"pairs-{table.column('bucket')[0].as_py()}", key=key[order], count=count[order].astype(np.uint32))
        at, _ = _runs(context)
        out = _partial(False, context[at], [np.add.reduceat(x.astype(np.int64), at) for x in (count, count == 1, count == 2, count >= 3)], buckets)
        order = np.argsort(word, kind="stable")
        at, many = _runs(word[order])
        out += _partial(True, word[order][at], [many, np.add.reduceat(count[order], at)], buckets)
        f = _frequencies(count)
        names = [c.split()[0] for c in _SUMS.split(", ")]
        cols = [*zip(*out, strict=True), *([x] + [0] * (len(out) - 1) for x in f)]
        kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), *(pa.int64(),) * 4)
        return pa.table({k: pa.array(c, t) for k, c, t in zip(names, cols, kinds, strict=True)})

    def sums_of(table: pa.Table) -> pa.Table:
        rows, b = table.to_pylist(), table.column("bucket")[0].as_py()
        key, (total, n1, n2, n3) = _added([r for r in rows if not r["of_words"]], 4)
        store.write(f"contexts-{b}", key=key, total=total.astype(np.uint64), n1=n1.astype(np.uint32), n2=n2.astype(np.uint32), n3=n3.astype(np.uint32))
        key, (many, count) = _added([r for r in rows if r["of_words"]], 2)
        store.write(f"words-{b}", key=key, contexts=many.astype(np.uint64), count=count.astype(np.uint64))
        names = [c.split()[0] for c in _WORDS.split(", ")]
        return pa.table({k: pa.array([v], pa.int64()) for k, v in zip(names, [*_frequencies(many), int(many.sum()), int(count.sum()), len(many)], strict=True)})

    summed = stash(_count_pairs(docs, buckets).groupBy("bucket").applyInArrow(pairs_of, _SUMS), "sums")
    sums = lambda df: {c: df_c or 0 for c, df_c in df.agg(*(F.sum(c).alias(c) for c in df.columns)).first().asDict().items()}
    pairs = sums(summed.select("f1", "f2", "f3", "f4"))
    unigrams = sums(summed.groupBy("bucket").applyInArrow(sums_of, _WORDS))
    discard(summed)
    f = lambda x: [x[f"f{k}"] for k in (1, 2, 3, 4)]
    return {"url": url, "buckets": buckets, "D": discounts(f(pairs)), "E": discounts(f(unigrams)), "f": f(unigrams), **{k: unigrams[k] for k in ("total", "tokens", "types")}}


class Model:
    """A worker's view of the files, each mapped when first needed."""

    def __init__(self, model: dict):
        self.__dict__.update(model)
        self.store = Store(self.url)
        self.open: dict[str, dict] = {}

    def _file(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self.open:
            try:
                self.open[name] = self.store.map(name)
            except FileNotFoundError:  # nothing was counted in this bucket
                self.open[name] = None
        return self.open[name]

    def lookup(self, kind: str, bucket: np.ndarray, key: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """The columns of each key (0 where it is absent). ``bucket`` ascends."""
        out = [np.zeros(len(key)) for _ in columns]
        for a, n in zip(*_runs(bucket), strict=True):
            have = self._file(f"{kind}-{bucket[a]}")
            if have is None or not len(have["key"]):
                continue
            own = key[a : a + n]
            at = np.minimum(np.searchsorted(have["key"], own), len(have["key"]) - 1)
            ok = have["key"][at] == own
            for o, c in zip(out, columns, strict=True):
                o[a : a + n] = np.where(ok, have[c][at], 0)
        return out

    @staticmethod
    def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))

    def probabilities(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(word | context) and the count of the word, of every pair."""
        w, back = np.unique(word, return_inverse=True)
        follows, count = self.lookup("words", _bucket(w, self.buckets), w, ("contexts", "count"))
        f, total = self.f, max(self.total, 1)
        more = self.types - f[0] - f[1]
        h = (self.E[0] * f[0] + self.E[1] * f[1] + self.E[2] * more) / total if self.types else 1.0
        q = ((follows - self._discount(follows, self.E)) / total + h / (self.types + 1))[back]
        key = pair_hash(context, word)
        order = np.argsort(key, kind="stable")
        c = np.empty(len(key))
        c[order] = self.lookup("pairs", _bucket(key[order], self.buckets), key[order], ("count",))[0]
        order = np.argsort(context, kind="stable")
        u, c = context[order], c[order]
        at, n = _runs(u)
        u = u[at]
        seen, n1, n2, n3 = (np.repeat(x, n) for x in self.lookup("contexts", _bucket(u, self.buckets), u, ("total", "n1", "n2", "n3")))
        q, p = q[order], np.empty(len(order))
        g = np.where(seen > 0, self.D[0] * n1 + self.D[1] * n2 + self.D[2] * n3, 1.0)
        p[order] = ((c - self._discount(c, self.D)) + g * q) / np.maximum(seen, 1)
        return p, count[back]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""

    schema = f"`{id_col}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model)
        n_train = m.tokens
        for batch in batches:
            for part, texts in slices(batch, "text"):
                context, word, first = sequence(texts)
                p, count = m.probabilities(context, word)
                base = np.log10((count + 0.5) / (n_train + 0.5 * (m.types + 1)))
                per = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023, E731
                total, n = per(np.log10(p)), np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(n), pa.array(per((count > 0).astype(np.int64))), pa.array(np.full(len(n), n_train, np.int64)), pa.array(per(base)), pa.array(total), pa.array(10 ** (-total / n))],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), (fold(id_col) == HELD_FOLD).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(rows, schema.replace(f"`{id_col}`", "id", 1)).withColumnRenamed("id", id_col)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows outside the held-out fold and scores all."""
    spark: SparkSession = docs.sparkSession
    learned = docs.filter(fold(id_col) != HELD_FOLD).select(F.col(text_col).cast("string").alias("text"))
    return score(docs, train(learned, new_path(spark, "model"), max(64, buckets_for(learned, "text"))), id_col, text_col)
