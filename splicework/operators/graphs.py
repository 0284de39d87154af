"""Graphs as edge tables (key, src, dst); iterations are joins with checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written


def statistics(vertices: DataFrame, edge_rows: DataFrame, keys: Sequence[str], length: str = "l") -> DataFrame:
    """Vertices, edges, the shortest length and how often it occurs."""
    low = vertices.groupBy(*keys).agg(F.count("*").alias("vertices"), F.min(length).alias("shortest"))
    often = vertices.join(low.select(*keys, "shortest"), list(keys)).groupBy(*keys).agg(F.count_if(F.col(length) == F.col("shortest")).alias("shortest_count"))
    n = edge_rows.groupBy(*keys).agg(F.count("*").alias("edges"))
    return low.join(often, list(keys)).join(n, list(keys), "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def too_complex(stats: DataFrame, est_length: str = "length", seed: int = 15) -> DataFrame:
    """The gate that asks for longer seeds (G04): column too_complex."""
    v, e = F.col("vertices"), F.col("edges")
    small = (v < 5) | (e < 4)
    ratio = F.col(est_length) / seed
    many = ((v > 80) & (F.col("shortest_count") > 0.4 * v)) | (e > 5 * v) | (v > 2 * ratio) | ((v > ratio) & (v >= 50)) | (e > 1000) | (v > 2000)
    return stats.withColumn("too_complex", ~small & many)


def sources(edge_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices with edges that none enters."""
    left = edge_rows.select(*keys, F.col("src").alias("node")).distinct()
    return left.join(edge_rows.select(*keys, F.col("dst").alias("node")).distinct(), [*keys, "node"], "left_anti")


def without_dangling(edge_rows: DataFrame, keys: Sequence[str], starts: DataFrame, stops: DataFrame) -> DataFrame:
    """Edges between vertices that have a way in and a way out, or are among the
    starts or stops (key, node): removed until nothing changes (G02)."""
    now, n = edge_rows, edge_rows.count()
    while True:
        into = now.select(*keys, F.col("dst").alias("src")).unionByName(starts.select(*keys, F.col("node").alias("src"))).distinct()
        out = now.select(*keys, F.col("src").alias("dst")).unionByName(stops.select(*keys, F.col("node").alias("dst"))).distinct()
        now = cut_lineage(now.join(into, [*keys, "src"], "left_semi").join(out, [*keys, "dst"], "left_semi").select(edge_rows.columns))
        m = now.count()
        if m == n:
            return now
        n = m


def transitive_reduction(edge_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges of a DAG that no path of two edges replaces (G04, G09). With the edges of
    a transitively closed DAG this is its reduction."""
    first = edge_rows.select(*keys, "src", F.col("dst").alias("mid"))
    second = edge_rows.select(*keys, F.col("src").alias("mid"), "dst")
    long = first.join(second, [*keys, "mid"]).select(*keys, "src", "dst").distinct()
    return edge_rows.join(long, [*keys, "src", "dst"], "left_anti")


def closure(edge_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which vertices each one reaches, in steps that double."""
    now = cut_lineage(edge_rows.select(*keys, "src", "dst").distinct())
    n = now.count()
    while True:
        further = now.select(*keys, F.col("src").alias("mid"), "dst")
        paths = now.select(*keys, "src", F.col("dst").alias("mid")).join(further, [*keys, "mid"]).select(*keys, "src", "dst")
        now = cut_lineage(now.unionByName(paths).distinct())
        m = now.count()
        if m == n:
            return now
        n = m


def contract_short(edge_rows: DataFrame, keys: Sequence[str], most: int = 3) -> DataFrame:
    """Pairings on one diagonal that are at most ``most`` apart made one (G04): input
    edges (p1, t1, l1, p2, t2, l2); output the merged pairings (p, t, l)."""
    near = edge_rows.filter((F.col("t2") - F.col("p2") == F.col("t1") - F.col("p1")) & ((F.col("p2") - F.col("p1") - F.col("l1")).between(-(10**6), most)))
    return near.select(*keys, F.col("p1").alias("p"), F.col("t1").alias("t"), F.greatest(F.col("l1"), F.col("p2") + F.col("l2") - F.col("p1")).alias("l"))


def paths(edge_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every maximal path from a source to a sink (G03, G11): (keys, path array), however
    many there are. Each round adds a vertex to all open paths, as one join, and is written
    as a table; whether an edge leads to a sink is known before, so that ended paths take
    no part in further joins."""
    kind = edge_rows.schema["src"].dataType
    every = written(edge_rows.select(*keys, F.col("src").alias("_last"), F.col("dst").cast(kind).alias("_next")).distinct())
    leaves = every.select(*keys, F.col("_last").alias("_next"), F.lit(False).alias("_ends")).distinct()
    ahead = written(every.join(leaves, [*keys, "_next"], "left").withColumn("_ends", F.coalesce("_ends", F.lit(True))))
    open_ = sources(edge_rows, keys).select(*keys, F.array(F.col("node").cast(kind)).alias("path"))
    done = None
    while True:
        grown = open_.withColumn("_last", F.element_at("path", -1)).join(ahead, [*keys, "_last"])
        grown = written(grown.select(*keys, F.concat("path", F.array("_next")).alias("path"), "_ends"), "_ends")
        ended = grown.filter("_ends").select(*keys, "path")
        done = ended if done is None else done.unionByName(ended)
        open_ = grown.filter("NOT _ends").select(*keys, "path")
        if open_.isEmpty():
            return done


def topological_level(edge_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, level): the longest way from a source."""
    level = sources(edge_rows, keys).withColumn("level", F.lit(0))
    now, out = level, level
    while True:
        step = now.join(edge_rows.select(*keys, F.col("src").alias("node"), "dst"), [*keys, "node"]).select(*keys, F.col("dst").alias("node"), (F.col("level") + 1).alias("level")).distinct()
        now = cut_lineage(step)
        if now.isEmpty():
            return out.groupBy(*keys, "node").agg(F.max("level").alias("level"))
        out = out.unionByName(now)
