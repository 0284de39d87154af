"""Near-duplicates by ProbMinHash, banding and exact verification.

A text's shingles (five words, with their counts as weights) send arrivals of Poisson
processes to the registers of its signature; a register keeps the earliest arrival's
shingle, and a text stops as soon as no later arrival can be the earliest anywhere.
Two texts agree in a register with the probability of their probability Jaccard; under
weights of 1, which texts with repeated shingles are signed with too, this is the Jaccard
of their sets, by which links are decided, however much their counts differ.

Equal texts are collapsed first. Signatures are cut into bands; texts with an equal
band are candidates. In each such bucket the most central text (with the most
companions over all its buckets) is the pivot and is paired with the others, so that a
bucket of n texts gives n - 1 pairs; the pairs are verified on whole shingle sets
(Jaccard of at least 0.8). Texts of buckets that are then still in several classes are
compared across classes by an exact prefix filter: of two sets that similar, the
shingles that come first in any common order must meet, and with the rarest first
(by a sketch of fixed size) those of large groups don't; and the shingles that no other
text has bound what two sets can share. So no link between classes
is lost, and no group is compared pair by pair. Classes are the connected components
of the verified links, found by repeated joins.

Defined cases: a text of fewer than five words (but not none) is one shingle; texts
without words, nulls too, are near only to equal texts; null texts are equal; repeated rows share a class; of rows with
one id but several texts each has its own text's class; a null id has no class and
stays; an empty table gives an empty result; other columns are ignored. A
class is named by its least id; of several classes with one least id, all but one are named
by a hash of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stash
from .textops import SPACE_WORDS, Slice, mix, pair_hash, slices

SHINGLE = 5
BANDS = 32
ROWS = 5
THRESHOLD = 0.8
#: Cells of the sketch that orders shingles by how common they are.
SKETCH_BITS = 18
SKETCH = 1 << SKETCH_BITS
#: Bytes of text that are worked on at once.
SLICE = 1 << 20


def shingles(words: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle, sorted by document."""
    h, of = words.hashes(), words.doc_of_word()
    n = words.n_words
    k = SHINGLE
    docs, hashes = [], []
    if len(h) >= k:
        roll = h[: len(h) - k + 1]
        for j in range(1, k):
            roll = pair_hash(roll, h[j : len(h) - k + 1 + j])
        ok = of[: len(roll)] == of[k - 1 :]
        docs.append(of[: len(roll)][ok])
        hashes.append(roll[ok])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        docs.append(short)
        one = []
        for i in short:
            x = h[words.word_first[i] : words.word_first[i + 1]]
            one.append(x[0] if len(x) == 1 else pair_hash(x[:1], np.bitwise_xor.reduce(mix(x + np.arange(len(x), dtype=np.uint64)), keepdims=True))[0])
        hashes.append(np.array(one, np.uint64))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[first], value[first], np.diff(np.append(first, len(doc)))


def signatures(n_docs: int, doc: np.ndarray, value: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """The shingle of the earliest arrival in each of ``size`` registers of each text.

    In round r every shingle that may still be early somewhere draws its r-th
    arrival: the time is an exponential step (rate: its weight) later, the register
    is uniform. A shingle ends once its time passes its text's latest register.
    """
    best = np.full(n_docs * size, np.inf)
    owner = np.zeros(n_docs * size, np.uint64)
    time = np.zeros(len(doc))
    seed, live, r = value, np.arange(len(doc)), 0
    while len(live):
        r += 1
        seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
        uniform = ((seed >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        time = time - np.log(uniform) / weight[live]
        to = doc[live] * size + ((mix(seed ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        early = time < best[to]
        t, s = time[early], to[early]
        # the earliest arrival of each register, ties by shingle
        order = np.lexsort((value[live[early]], t, s))
        s, t, v = s[order], t[order], value[live[early]][order]
        first = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        best[s[first]], owner[s[first]] = t[first], v[first]
        latest = best.reshape(n_docs, size).max(axis=1)
        more = time < latest[doc[live]]
        live, time, seed = live[more], time[more], seed[more]
    return owner.reshape(n_docs, size)


def _bands(signature: np.ndarray) -> np.ndarray:
    """The hash of each band of each signature."""
    signature = signature.reshape(-1, BANDS, ROWS)
    band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), signature.shape[:2])
    for j in range(ROWS):
        band = pair_hash(band, signature[:, :, j])
    return band


def _signed(texts: DataFrame) -> DataFrame:
    """doc and its bands' hashes, for every row (doc, text) with words; once more under
    weights of 1 where a shingle occurs several times."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, "text", SLICE):
                doc, value, weight = shingles(Slice(raw, False, SPACE_WORDS))
                some = np.unique(doc)
                at = np.searchsorted(some, doc)
                band = _bands(signatures(len(some), at, value, weight, BANDS * ROWS))
                # without counts: the same signature where each shingle occurs once
                counted = np.unique(at[weight > 1])
                own = np.isin(at, counted)
                plain = _bands(signatures(len(counted), np.searchsorted(counted, at[own]), value[own], np.ones(own.sum()), BANDS * ROWS))
                for docs, found in ((some, band), (some[counted], plain)):
                    offsets = pa.array(np.arange(len(docs) + 1) * BANDS, pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(docs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(found.astype(np.int64).ravel()))], ["doc", "bands"])

    return texts.mapInArrow(rows, "doc bigint, bands array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    """doc and its sorted shingle hashes, for every row (doc, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, "text", SLICE):
                doc, value, _ = shingles(Slice(raw, False, SPACE_WORDS))
                cut = np.searchsorted(doc, np.arange(len(raw) + 1))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc", "shingles"])

    return texts.mapInArrow(rows, "doc bigint, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sorted sets of hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the threshold's Jaccard at least."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [jaccard(x, y) >= threshold for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(got, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(rows, "a bigint, b bigint")


def _settled(edges: DataFrame) -> bool:
    """Whether every edge (a > b) leads straight to the least node of its component: each
    node has one edge down at most, and none if others lead to it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("reached")).filter("down > 1 OR (down = 1 AND reached = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(doc, class): each node's least reachable node. Large-star and small-star
    steps alternate: they link nodes to the least neighbour until all edges do."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.join(low, "a")
        moved = linked.filter(F.col("b") > F.col("a")) if large else linked.filter(F.col("b") != F.col("m"))
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionAll(low.select("a", F.col("m").alias("b")))
        return out.filter("a != b")

    e = stash(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(e):
        # edges that a large step repeats are as few as before it; the small one drops them
        last, e = e, stash(star(star(e, True), False).distinct(), "edges")
        discard(last)
    return e.select(F.col("a").alias("doc"), F.col("b").alias("class"))


def _pivots(member: DataFrame) -> DataFrame:
    """Pairs (a < b) of each bucket's most central text and its others, for the rows (doc,
    band, n) of buckets of n texts."""
    central = member.groupBy("doc").agg(F.sum("n").alias("companions"))
    known = member.join(central, "doc")
    pivot = known.groupBy("band").agg(F.min(F.struct((-F.col("companions")).alias("c"), "doc")).alias("least")).select("band", F.col("least.doc").alias("pivot"))
    pairs = member.select("doc", "band").join(pivot, "band").filter("doc != pivot")
    return pairs.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()


def _sketch(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` fall in each of SKETCH cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for x in batch.column("shingles").to_pylist():
                np.add.at(total, (np.frombuffer(x, np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        parts = total.reshape(64, -1)
        yield pa.RecordBatch.from_pydict({"part": np.arange(64), "counts": [p.tobytes() for p in parts]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "counts": [total.tobytes()]})

    rows = sets.select("shingles").mapInArrow(count, "part bigint, counts binary").groupBy("part").applyInArrow(add, "part bigint, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows)]) if rows else np.zeros(SKETCH, np.int64)


def _unshared(sets: DataFrame) -> DataFrame:
    """(doc, alone): how many of its shingles no other row of ``sets`` has."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                values = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
                docs = np.repeat(part.column("doc").to_numpy(), [len(v) for v in values])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.concatenate(values), pa.int64())], ["doc", "shingle"])

    rows = sets.select("doc", "shingles").mapInArrow(flat, "doc bigint, shingle bigint")
    once = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).filter("n = 1")
    return once.groupBy("doc").agg(F.count("*").alias("alone"))


def _across(sets: DataFrame, member: DataFrame, classes: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b) across classes that the prefix filter lets pass, among the texts
    of buckets with several classes, without those of ``known``."""
    named = member.join(classes, "doc", "left").select("band", "doc", F.coalesce("class", "doc").alias("class"))
    mixed = named.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("band")
    rest = stash(named.join(mixed, "band", "left_semi").select("doc", "class").distinct(), "rest")
    own = sets.join(rest, "doc")
    sent = sets.sparkSession.sparkContext.broadcast(_sketch(own))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, classes_, sizes, places, out = [], [], [], [], []
            for doc, x, c in zip(batch.column("doc").to_pylist(), batch.column("shingles").to_pylist(), batch.column("class").to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint64)
                n = len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1
                first = x[np.lexsort((x, sent.value[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:n]]
                out.append(first.astype(np.int64))
                docs.append(np.full(len(first), doc))
                classes_.append(np.full(len(first), c))
                sizes.append(np.full(len(first), len(x)))
                places.append(np.arange(len(first)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (docs, classes_, sizes, places, out)], ["doc", "class", "size", "place", "shingle"])

    every = own.select("doc", "class", "shingles").mapInArrow(prefixes, "doc bigint, class bigint, size bigint, place bigint, shingle bigint")
    # from the first shingle that two texts share on, neither has more than what is left
    # of it; and a shingle that no other text has meets nothing
    every = every.join(_unshared(own), "doc", "left").withColumn("open", F.col("size") - F.greatest(F.coalesce("alone", F.lit(0)), "place")).drop("alone", "place")
    every = stash(every.filter(F.col("open") >= threshold * F.col("size") - 1e-9), "prefixes")
    several = every.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("shingle")
    left = every.join(several, "shingle", "left_semi")
    right = left.select("shingle", F.col("doc").alias("b"), F.col("class").alias("cb"), F.col("size").alias("nb"), F.col("open").alias("ob"))
    overlap = F.least("open", "ob")
    near = (F.col("doc") < F.col("b")) & (F.col("class") != F.col("cb")) & (overlap >= threshold * (F.col("size") + F.col("nb") - overlap) - 1e-9)
    pairs = stash(left.join(right, "shingle").filter(near).select(F.col("doc").alias("a"), "b").distinct().join(known, ["a", "b"], "left_anti"), "across")
    discard(rest, every)
    return pairs


@small_batches
def classes_of(texts: DataFrame, first: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, class) of the rows of ``texts`` (doc, text) that are linked to others.
    ``first`` has the documents (doc) to compare: one of each set of equal texts."""
    every = stash(_signed(texts), "signed")
    # one row a text, each band once, so that buckets count texts
    signed = every.join(first, "doc", "left_semi").groupBy("doc").agg(F.flatten(F.collect_set("bands")).alias("bands"))
    banded = signed.select("doc", F.explode(F.array_distinct("bands")).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    member = stash(banded.join(shared, "band"), "buckets")
    discard(every)
    sets = stash(_sets(texts.join(member.select("doc").distinct(), "doc", "left_semi")), "sets")
    pivots = stash(_pivots(member), "candidates")
    classes = components(verify(pivots, sets, threshold))
    across = _across(sets, member, classes, pivots, threshold)
    discard(member, pivots)
    found = components(verify(across, sets, threshold).unionAll(classes.select(F.col("doc").alias("a"), F.col("class").alias("b"))))
    discard(sets, across, classes)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id, class_size (rows) and kept (the class's least id) of every row."""
    key, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    # an id may have several texts: what is compared is named by both
    node = F.xxhash64(key, text).alias("doc")
    texts = docs.filter(key.isNotNull()).select(node, text.alias("text"))
    rows = stash(docs.select(key.alias("id"), node, F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)), F.lit(b"")).alias("key")), "rows")
    first = rows.groupBy("key").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "doc"))).alias("x")).select("key", F.col("x.doc").alias("node"))
    found = classes_of(texts, first.select(F.col("node").alias("doc")).filter("doc IS NOT NULL"), threshold)
    linked = found.select(F.col("doc").alias("node"), "class")
    named = first.join(linked, "node", "left").select("key", F.coalesce("class", "node").alias("class"))
    out = rows.join(named, "key").select("id", F.when(F.col("id").isNotNull(), F.col("class")).alias("class"))
    out = stash(out, "classes")
    discard(rows, found)
    size = stash(out.filter("class IS NOT NULL").groupBy(F.col("class").alias("of")).agg(F.count("*").alias("n"), F.min("id").alias("least")), "sizes")
    # classes that share their least id, as its rows have several texts: one takes its name
    owner = size.groupBy(F.col("least").alias("name")).agg(F.min("of").alias("owner"), F.count("*").alias("k")).filter("k > 1")
    called = size.join(owner, F.col("least") == F.col("name"), "left").select("of", "n", "least", F.when(F.col("owner") != F.col("of"), F.col("of")).otherwise(F.col("least")).alias("class_id"))
    known = F.col("id").isNotNull()
    return out.join(called, F.col("class") == F.col("of"), "left").select(
        F.col("id").alias(id_col), "class_id", F.when(known, F.col("n")).otherwise(1).alias("class_size"), F.coalesce(F.col("id") == F.col("least"), F.lit(True)).alias("kept")
    )
