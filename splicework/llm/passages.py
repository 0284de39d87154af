"""Removal of passages of over 50 words that several documents have, however few bytes
they take and whatever white space is between their words.

A window is WORDS consecutive words. Its anchor is the least hash of its GRAM-word strings;
equal windows have equal anchors, so windows whose anchor only one document has are done
without being counted. The others are hashed as a whole and counted by hash, added up
before they meet, so that no passage is too common.

``texts_with_passages`` only tells which texts have such a passage. There windows aren't
written one by one: a slice of texts settles those that it has several times itself and
sends one of each name to the bucket of its anchor (of its name, where the anchor is very
common), and a bucket sorts what comes. Texts are told apart by 64-bit hashes there.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a window that one document alone repeats stays;
every copy of a passage goes, from its first word's start to its last word's end; rows are
told apart by ``id_col``, which must be unique; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, discard, small_batches, stash
from .suffix_dedup import merged, text_key, text_number, without
from .textops import SPACE_WORDS, Slice, mix, pair_hash, slices

WORDS = 51
GRAM = 8
#: Windows of an anchor with more occurrences are dealt by name.
MANY = 2000
#: Bytes of text that are worked on at once.
SLICE = 1 << 20


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` of these, put together from runs of 1, 2, 4, ..."""
    n = max(len(h) - size + 1, 0)
    out, at, step = None, 0, 1
    while n and step <= size:
        if size & step:
            part = h[at : at + n]
            out = part if out is None else pair_hash(out, part)
            at += step
        h, step = pair_hash(h[:-step], h[step:]), 2 * step
    return np.zeros(0, np.uint64) if out is None else out


def windows(s: Slice, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, document and anchor of each window."""
    if len(h) < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = s.doc_of_word()
    start = np.flatnonzero(of[: len(h) - WORDS + 1] == of[WORDS - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(rolled(h, GRAM), WORDS - GRAM + 1).min(axis=1)
    return start, of[start], least[start]


def _anchored(texts: DataFrame) -> DataFrame:
    """row (and id), anchor, and whether it is the document's first, once for each run of
    windows that have it."""
    names = [c for c in texts.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, "text", SLICE):
                s = Slice(raw, False, SPACE_WORDS)
                _, doc, least = windows(s, s.hashes())
                head = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
                new = head.copy()
                new[1:] |= least[1:] != least[:-1]
                cols = [part.column(c).take(pa.array(doc[new])) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(least[new].astype(np.int64)), pa.array(head[new])], [*names, "gram", "head"])

    return texts.mapInArrow(rows, "".join(f"{c} bigint, " for c in names) + "gram bigint, head boolean")


def _wanted(part: pa.RecordBatch, raw: list[bytes | None]) -> tuple[Slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, and first word, document, anchor and name (a hash of the words) of the
    windows of these anchors."""
    s = Slice(raw, False, SPACE_WORDS)
    h = s.hashes()
    start, doc, least = windows(s, h)
    marks = part.column("grams")
    own = np.repeat(np.arange(len(raw)), np.diff(marks.offsets.to_numpy()))
    wanted = np.unique(pair_hash(own.astype(np.uint64), marks.flatten().to_numpy().astype(np.uint64)))
    own = np.isin(pair_hash(doc.astype(np.uint64), least), wanted)
    start, doc, least = start[own], doc[own], least[own]
    return s, start, doc, least, rolled(h, WORDS)[start].astype(np.int64)


def _named(held: DataFrame) -> DataFrame:
    """row, name, start and end byte of the windows of these anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, "text", SLICE):
                s, start, doc, _, name = _wanted(part, raw)
                base = s.first[doc]
                cols = [part.column("row").take(pa.array(doc)), pa.array(name)]
                cols += [pa.array(x, pa.int32()) for x in (s.start[start] - base, s.end[start + WORDS - 1] - base)]
                yield pa.RecordBatch.from_arrays(cols, ["row", "name", "start", "end"])

    return held.mapInArrow(rows, "row bigint, name bigint, start int, end int")


def _several(df: DataFrame, key: str) -> DataFrame:
    """The keys that several rows have, and whether more than MANY times."""
    return df.groupBy(key).agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select(key, (F.col("n") > MANY).alias("many"))


@small_batches
def passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, spans): the bytes of windows that several documents have; spans may overlap."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).cast("string").alias("text"))
    marks = stash(_anchored(texts), "anchors")
    marked = marks.join(_several(marks, "gram"), "gram", "left_semi").groupBy("row").agg(F.collect_set("gram").alias("grams"))
    found = stash(_named(texts.join(marked, "row")), "windows")
    spans = found.join(_several(found, "name"), "name", "left_semi").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    out = stash(spans, "spans")
    discard(marks, found)
    return out


def several_rows(name: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of names that several rows have, and the places of each name once."""
    order = np.argsort(name)
    name, row = name[order], row[order]
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
    several = np.minimum.reduceat(row, first) < np.maximum.reduceat(row, first) if len(first) else np.zeros(0, bool)
    met = np.unique(row[np.repeat(several, np.diff(np.append(first, len(name))))])
    return met, order[first]


def _dealt(held: DataFrame, buckets: int) -> DataFrame:
    """bucket, names and rows, as bytes: windows by their anchor, or by their name where an
    anchor is in ``often``. Bucket -1 has the rows of names that several rows of one slice
    have; of these one alone is dealt."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, "text", SLICE):
                _, _, doc, least, name = _wanted(part, raw)
                row = part.column("row").to_numpy()[doc]
                met, once = several_rows(name, row)
                name, row, least = name[once], row[once], least[once]
                often = np.isin(least, part.column("often").flatten().to_numpy().astype(np.uint64))
                bucket = (mix(np.where(often, name.astype(np.uint64), least)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                to, at = np.unique(bucket[order], return_index=True)
                cuts = [order[a:b] for a, b in zip(at, np.append(at[1:], len(order)), strict=True)]
                cols = [[-1, *to.tolist()], [b"", *(name[i].tobytes() for i in cuts)], [met.tobytes(), *(row[i].tobytes() for i in cuts)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "names", "rows"])

    return held.mapInArrow(rows, "bucket int, names binary, rows binary")


def _met(dealt: DataFrame) -> DataFrame:
    """row: those of bucket -1, and of names that come with several rows."""

    def unpacked(blobs: pa.ChunkedArray | pa.Array) -> np.ndarray:
        return np.frombuffer(bytearray().join(blobs.to_pylist()), np.int64)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(batch.column("rows")))], ["row"])

    def bucket(part: pa.Table) -> pa.Table:
        met, _ = several_rows(unpacked(part.column("names")), unpacked(part.column("rows")))
        return pa.table({"row": met})

    apart = dealt.filter("bucket >= 0").groupBy("bucket").applyInArrow(bucket, "row bigint")
    return dealt.filter("bucket < 0").mapInArrow(settled, "row bigint").unionAll(apart)


@small_batches
def texts_with_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``text_number`` (column row) of each text with a passage that several documents
    have, its copies included. Of copies one is looked into; ids may repeat."""
    text = F.col(text_col).cast("string")
    texts = docs.select(text_number(text_key(text)).alias("row"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"), text.alias("text"))
    marks = stash(_anchored(texts), "anchors")
    copied = marks.filter("head").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
    shared = marks.join(_several(marks, "gram"), "gram")
    marked = shared.groupBy("row").agg(F.min("id").alias("id"), F.collect_set("gram").alias("grams"), F.collect_set(F.when(F.col("many"), F.col("gram"))).alias("often"))
    dealt = stash(_dealt(texts.join(marked, ["row", "id"]), buckets_for(texts, "text")), "windows")
    out = stash(_met(dealt).unionAll(copied).distinct(), "texts-with-passages")
    discard(marks, dealt)
    return out


@small_batches
def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages cut from the texts (nulls stay null)."""
    spans = passages(docs, id_col, text_col)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or s is None else without(t.encode(), merged(s)).decode())

    joined = docs.join(spans.withColumnsRenamed({"row": "__row", "spans": "__spans"}), F.col(id_col).cast("bigint") == F.col("__row"), "left")
    out = stash(joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("__spans")))).select(*docs.columns), "without-passages")
    discard(spans)
    return out
