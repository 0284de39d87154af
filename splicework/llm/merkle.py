"""A Merkle manifest of a dataset by time-forward processing.

Rows are leaves; the leaves of a group ascend by id, every FANOUT consecutive nodes become
one node, until one is left: the group's root. The groups' roots, in the order of the
groups, are the leaves of the tree above.

A tree is cut into blocks of FANOUT ** BLOCK_LEVELS consecutive nodes, each of which is a
subtree. Going up, a block is processed forward in time: nodes are labelled level by
level, an external priority queue ordered by label holds the digests that children have
sent to their parents, and a node is evaluated when its label is the least. The blocks'
tops are the nodes of the next round, until every tree has one. Going down, the same
blocks are swept in reverse order of labels: a node receives its proof suffix (the
siblings from its level to the root) through a queue, and sends it, with their siblings in
front, to its children; the suffix of a block's top comes from the round above. So no task
holds more than a block, and rounds are as many as the logarithm of the largest group to
the base of a block.

Leaves are numbered by a range partitioning over (group, id, digest and a row number), so
a group or an id that a third of all rows have is many partitions.

Defined cases: nulls of any column are leaves' ``-``; null groups and null ids come first;
rows of one id are ordered by digest, and equal rows have neighbouring places; a lone leaf
is its group's root, and a lone group's root is the root, each without a proof level; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

FANOUT = 8
BLOCK_LEVELS = 4
#: Entries that a queue holds in memory before it writes a sorted run.
QUEUE_ENTRIES = 1 << 16

_PROOF = "array<struct<before: string, after: string>>"


class ExternalQueue:
    """A priority queue of (label, value), smallest first. Beyond ``most`` entries in
    memory the larger half is written as a sorted run to an unnamed file, which goes with
    the task; runs are read back entry by entry."""

    def __init__(self, most: int = QUEUE_ENTRIES):
        self.most, self.heap, self.count = most, [], 0
        self.heads: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []

    def push(self, label: tuple, value) -> None:
        self.count += 1
        heapq.heappush(self.heap, (label, self.count, value))
        if len(self.heap) > self.most:
            ordered = sorted(self.heap)
            self.heap = ordered[: self.most // 2]
            self._spill(ordered[self.most // 2 :])

    def _spill(self, entries: list[tuple]) -> None:
        file = tempfile.TemporaryFile()
        for x in entries:
            pickle.dump(x, file)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                for _ in range(len(entries)):
                    yield pickle.load(file)

        self.runs.append(read())
        self._advance(len(self.runs) - 1)

    def _advance(self, run: int) -> None:
        if (x := next(self.runs[run], None)) is not None:
            heapq.heappush(self.heads, (*x[:2], run, x[2]))

    def first(self) -> tuple | None:
        """The least label, or None where the queue is empty."""
        return min((h[0][0] for h in (self.heap, self.heads) if h), default=None)

    def pop(self):
        if self.heads and (not self.heap or self.heads[0][:2] < self.heap[0][:2]):
            *_, run, value = heapq.heappop(self.heads)
            self._advance(run)
            return value
        return heapq.heappop(self.heap)[2]


def _digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(n_block: int, n_tree: int, fanout: int, block_levels: int) -> int:
    """How many levels a block goes up: until one node is left where the block is the
    whole tree, all of them otherwise (a short run becomes a node too)."""
    if n_tree > fanout**block_levels:
        return block_levels
    levels = 0
    while n_block > 1:
        n_block, levels = -(-n_block // fanout), levels + 1
    return levels


def evaluate(nodes: Sequence[str], levels: int, fanout: int = FANOUT, most: int = QUEUE_ENTRIES) -> list[list[str]]:
    """All levels of a block, lowest first, forward in time: labels are (level, place)."""
    queue, out = ExternalQueue(most), [list(nodes), *([] for _ in range(levels))]
    if not levels:
        return out
    for i, x in enumerate(nodes):
        queue.push((1, i // fanout), x)
    while (label := queue.first()) is not None:
        children = []
        while queue.first() == label:
            children.append(queue.pop())
        level, place = label
        out[level].append(made := _digest(children))
        if level < levels:
            queue.push((level + 1, place // fanout), made)
    return out


def sweep(levels: list[list[str]], suffix: list[tuple[str, str]], fanout: int = FANOUT, most: int = QUEUE_ENTRIES) -> list[list[tuple[str, str]]]:
    """The proof of every leaf of a block, lowest level first: nodes are taken in reverse
    order of labels, and send each child its siblings and their own suffix."""
    queue = ExternalQueue(most)
    top = len(levels) - 1
    out: list[list[tuple[str, str]]] = [[] for _ in levels[0]]
    for i in range(len(levels[top])):
        queue.push((-top, -i), suffix)
    while (label := queue.first()) is not None:
        own = queue.pop()
        level, place = -label[0], -label[1]
        if level == 0:
            out[place] = own
            continue
        first = place * fanout
        run = levels[level - 1][first : first + fanout]
        for j in range(len(run)):
            queue.push((1 - level, -(first + j)), [("".join(run[:j]), "".join(run[j + 1 :])), *own])
    return out


def numbered(leaves: DataFrame, group: str, *order: str) -> DataFrame:
    """``leaves`` with ``place`` (gapless from 0 within the group) and ``n`` (the group's
    rows). Sorted ranges are counted by group, and the counts added up."""
    row = F.monotonically_increasing_id()
    ranged = leaves.withColumn("_salt", row).repartitionByRange(group, *order, "_salt").sortWithinPartitions(group, *order, "_salt").drop("_salt")
    held = stash(ranged.select("*", F.spark_partition_id().alias("_part"), row.alias("_row")), "leaves")
    parts = held.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    # one row for each partition that has the group
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    return held.join(placed, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p"))).select(*leaves.columns, (F.col("_row") + F.col("_shift")).alias("place"), "n")


def _tops(nodes: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """(tree, place, n, digest) of the blocks' tops of (tree, place, n, digest)."""
    wide = fanout**block_levels

    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        n = t.column("n")[0].as_py()
        levels = evaluate(t.column("digest").to_pylist(), _levels(len(t), n, fanout, block_levels), fanout)
        return pa.table({"tree": t.column("tree").slice(0, 1), "place": [t.column("place")[0].as_py() // wide], "n": [-(-n // wide)], "digest": levels[-1]})

    block = F.floor(F.col("place") / wide)
    return nodes.groupBy("tree", block.alias("_block")).applyInArrow(up, "tree string, place bigint, n bigint, digest string")


def _proofs(nodes: DataFrame, above: DataFrame, extra: str, fanout: int, block_levels: int) -> DataFrame:
    """``nodes`` (tree, place, n, digest and the columns ``extra``) with their proof,
    subroot and root; ``above`` has (up_tree, up_place, proof, subroot, root) of the blocks' tops."""
    wide = fanout**block_levels
    names = [c.split()[0] for c in extra.split(", ")] if extra else []
    proof_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def down(own: pa.Table, top: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        head = top.to_pylist()[0]
        levels = evaluate(own.column("digest").to_pylist(), _levels(len(own), own.column("n")[0].as_py(), fanout, block_levels), fanout)
        found = sweep(levels, [(x["before"], x["after"]) for x in head["proof"]], fanout)
        flat = [p for proof in found for p in proof]
        sides = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string())], ["before", "after"])
        offsets = [0]
        for proof in found:
            offsets.append(offsets[-1] + len(proof))
        n = len(own)
        return pa.table({c: own.column(c) for c in ("tree", "place", *names, "digest")} | {"proof": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), sides).cast(proof_type), "subroot": [head["subroot"]] * n, "root": [head["root"]] * n})

    schema = ", ".join(["tree string, place bigint", *([extra] if extra else []), f"digest string, proof {_PROOF}, subroot string, root string"])
    block = F.floor(F.col("place") / wide).alias("_block")
    return nodes.groupBy("tree", block).cogroup(above.groupBy("up_tree", "up_place")).applyInArrow(down, schema)


def _rounds(leaves: DataFrame, fanout: int, block_levels: int) -> list[DataFrame]:
    """The nodes of each round, the leaves first, the trees' roots last."""
    out = [leaves]
    while (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        out.append(stash(_tops(out[-1].select("tree", "place", "n", "digest"), fanout, block_levels), "nodes"))
    return out


def _down(rounds: list[DataFrame], roots: DataFrame, extra: str, fanout: int, block_levels: int) -> DataFrame:
    """Proofs of the leaves; ``roots`` has (tree, proof, subroot, root) of each tree."""
    named = F.col("tree").alias("up_tree"), F.col("place").alias("up_place"), "proof", "subroot", "root"
    above = roots.withColumn("place", F.lit(0).cast("bigint")).select(*named)
    if len(rounds) == 1:  # every leaf is a root
        return rounds[0].join(above, F.col("tree") == F.col("up_tree")).select("tree", "place", *[c.split()[0] for c in extra.split(", ") if c], "digest", "proof", "subroot", "root")
    for nodes in rounds[-2:0:-1]:
        above = stash(_proofs(nodes, above, "", fanout, block_levels).select(*named), "proofs")
    return _proofs(rounds[0], above, extra, fanout, block_levels)


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the columns: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)).cast("binary"), 256)


def proofs(leaves: DataFrame, extra: str = "", fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Leaves (grp string, ord, digest, and the columns of the schema ``extra``) with
    subroot, root and ``proof``: for each level, lowest first, the joined digests of the
    siblings before and after."""
    # an order of strings in which null comes first
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "grp"), F.lit("")))
    ranked = numbered(keyed, "tree", "ord", "digest")
    kept = ["tree", "place", "n", *[c.split()[0] for c in extra.split(", ") if c], "digest"]
    rounds = _rounds(stash(ranked.select(*kept), "leaves"), fanout, block_levels)
    subroots = numbered(rounds[-1].select(F.lit("").alias("one"), F.col("tree").alias("name"), "digest"), "one", "name", "digest")
    upper = _rounds(stash(subroots.select(F.col("one").alias("tree"), "place", "n", "name", "digest"), "subroots"), fanout, block_levels)
    root = upper[-1].select("tree", F.array().cast(_PROOF).alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = stash(_down(upper, root, "name string", fanout, block_levels).select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"), "tops")
    return _down(rounds, tops, extra, fanout, block_levels)


def fold(digest: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    return F.aggregate(proof, digest, lambda x, p: F.sha2(F.concat(p["before"], x, p["after"]).cast("binary"), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", text_col: str = "text", tampered: Column | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """id, leaf, subroot, root, a digest of the proof, the root that follows from the leaf
    (where ``tampered``, from that of the row with its text's A-Z in lower case) and
    whether it is the root. Texts are digested where they are read and go no further."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = leaf_digest(*(F.translate(F.col(c).cast("string"), upper, lower) if c == text_col else F.col(c) for c in columns))
    leaves = docs.select(F.col(id_col).cast("bigint").alias("ord"), F.col(group_col).cast("string").alias("grp"), leaf_digest(*map(F.col, columns)).alias("digest"), F.when(F.coalesce(tampered, F.lit(False)), changed).alias("changed") if tampered is not None else F.lit(None).cast("string").alias("changed"))
    found = proofs(stash(leaves, "digests"), "ord bigint, changed string", fanout, block_levels)
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    folded = found.select(F.col("ord").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), fold(F.coalesce("changed", "digest"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
