r"""Chat formatting of reply trees, in DataFrame functions only.

A conversation is a tree of messages. Self-joins that double their reach each round
give every message its root, depth and the summed score of its path; leaves are ranked
by that score (ties: the lesser id), and the chosen leaves' paths are gathered by the
same doubled steps, read from the longest to the shortest. A chain of n messages
takes about log2(n) joins each way, and no message carries its path along.

A turn is ``### role: text``, a newline, ``</turn>`` and a newline. In roles and texts
a backslash goes before each backslash, ``#`` and ``<`` (in roles also ``:``), so that
no text holds a control string, and read_back inverts it. The loss mask lists the
assistant's texts: turn (from 0), offset and length in the turn, and start in the whole.

Defined cases: null roles and texts are empty; null conversation ids are one
conversation; a parent that isn't there makes a message a root; messages on a cycle
have no root and are left out; messages that repeat an id are kept apart by linear(),
which numbers rows by turn (nulls first), role and text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

END_OF_TURN = "\n</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{more}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of conversations without
    branches: each row replies to the one before it."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    picked = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), who.alias("role"), body.alias("text"))
    numbered = picked.withColumn("id", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("bigint"))
    return numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same_tree(a: DataFrame, b: DataFrame, key: str, other: str) -> Column:
    return a["tree"].eqNullSafe(b["of"]) & (a[key] == b[other])


def _ancestors(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, id, score, depth) of the messages that have a root, and for k = 0, 1, ...
    the steps (of, from_id, to_id) to the ancestor 2**k above."""
    here = messages.select(F.col("tree").alias("of"), F.col("id").alias("parent_id"))
    real = messages.join(here, messages["tree"].eqNullSafe(here["of"]) & (messages["parent"] == here["parent_id"]), "left").select("tree", "id", F.col("parent_id").alias("up"), "score", F.lit(1).cast("bigint").alias("depth"))
    now = stash(real, "reach")
    most = now.count()
    steps: list[DataFrame] = []
    while True:
        open_ = now.filter("up IS NOT NULL")
        if open_.isEmpty() or 1 << len(steps) > most:
            return now.filter("up IS NULL").select("tree", "id", "score", "depth"), steps
        steps.append(open_.select(F.col("tree").alias("of"), F.col("id").alias("from_id"), F.col("up").alias("to_id")))
        above = now.select(F.col("tree").alias("of"), F.col("id").alias("above_id"), F.col("up").alias("above_up"), F.col("score").alias("above_score"), F.col("depth").alias("above_depth"))
        joined = open_.join(above, _same_tree(open_, above, "up", "above_id"))
        moved = joined.select("tree", "id", F.col("above_up").alias("up"), (F.col("score") + F.col("above_score")).alias("score"), (F.col("depth") + F.col("above_depth")).alias("depth"))
        now = stash(now.filter("up IS NULL").unionAll(moved), "reach")


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, rank, leaf, id, depth): the messages of the ``top`` best paths from root
    to leaf in each tree."""
    rooted, steps = _ancestors(messages)
    parents = messages.filter("parent IS NOT NULL").select(F.col("tree").alias("of"), F.col("parent").alias("parent_id")).distinct()
    leaves = rooted.join(parents, _same_tree(rooted, parents, "id", "parent_id"), "left_anti")
    order = F.struct((-F.col("score")).alias("cost"), F.col("id"))
    if top == 1:
        chosen = leaves.groupBy("tree").agg(F.min(order).alias("best")).select("tree", F.lit(1).alias("rank"), F.col("best.id").alias("leaf"))
    else:
        ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(order)))
        chosen = ranked.filter(F.col("rank") <= top).select("tree", "rank", F.col("id").alias("leaf"))
    path = chosen.withColumn("id", F.col("leaf"))
    for k in reversed(range(len(steps))):
        path = stash(path, "path")
        up = path.join(steps[k], _same_tree(path, steps[k], "id", "from_id"))
        path = path.unionAll(up.select("tree", "rank", "leaf", F.col("to_id").alias("id")))
    depth = rooted.select(F.col("tree").alias("of"), F.col("id").alias("rooted_id"), "depth")
    path = stash(path, "path")
    return path.join(depth, _same_tree(path, depth, "id", "rooted_id")).select("tree", "rank", "leaf", "id", "depth")


def format_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, rank, formatted, loss array<struct<turn, start, offset, length>>) of the
    chosen paths; starts and offsets count code points from 0."""
    path = best_paths(messages, top).select(F.col("tree").alias("of"), "rank", F.col("id").alias("path_id"), "depth")
    head = F.concat(F.lit("### "), escape(F.coalesce("role", F.lit("")), ":"), F.lit(": "))
    body = escape(F.coalesce("text", F.lit("")))
    said = messages.select("tree", "id", (F.col("role") == ASSISTANT).alias("learned"), F.length(head).alias("offset"), F.length(body).alias("length"), F.concat(head, body, F.lit(END_OF_TURN)).alias("turn"))
    rows = path.join(said, said["tree"].eqNullSafe(path["of"]) & (said["id"] == path["path_id"]))
    before = Window.partitionBy("tree", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)))
    span = F.when(
        F.col("learned"),
        F.struct((F.col("depth") - 1).cast("int").alias("turn"), (F.col("start") + F.col("offset")).alias("start"), F.col("offset"), F.col("length")),
    )
    turns = F.array_sort(F.collect_list(F.struct("depth", "turn")))
    return rows.groupBy("tree", "rank").agg(F.array_join(F.transform(turns, lambda t: t["turn"]), "").alias("formatted"), F.array_sort(F.collect_list(span)).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (array<struct<role, text>>) and ``learned`` (the text
    under the loss mask), both taken from the formatted text."""
    pieces = F.split("formatted", END_OF_TURN, -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    shape = r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$"
    turn = lambda p: F.struct(unescape(F.regexp_extract(p, shape, 1)).alias("role"), unescape(F.regexp_extract(p, shape, 2)).alias("text"))
    under = F.transform("loss", lambda s: F.substring(F.element_at(F.col("pieces"), s["turn"] + 1), s["offset"] + 1, s["length"]))
    cut = formatted.withColumn("pieces", pieces)
    return cut.withColumn("turns", F.transform("pieces", turn)).withColumn("learned", unescape(F.array_join(under, ""))).drop("pieces")


def digests(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias(conv),
        F.size("turns").cast("bigint").alias("n_turns"),
        sha(said).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        sha(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
