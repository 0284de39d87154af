"""Sharding by jump consistent hashing, in DataFrame functions only.

Law ``key``: the key and the number of shards decide a row's shard, and one
more shard takes rows only into itself. No table of ring points exists.

Defined cases: a null key counts as key 0; keys that are not integers are
hashed with xxhash64 first; a null text has no bytes (size 1, checksum 0);
repeated rows share a shard and get slots of their own; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash

#: Fixed value: the multiplier of the generator in the jump hash paper.
JUMP_MULTIPLIER = 2862933555777941757
_LOW32 = 0xFFFFFFFF
#: Steps tried for every row; the expected number is the logarithm of the shards.
FIRST_STEPS = 48


def _long(x) -> Column:
    return F.lit(x).cast("bigint")


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * JUMP_MULTIPLIER + 1 modulo 2**64 on two unsigned 32-bit halves; no
    intermediate value passes 2**50, so ANSI mode raises no overflow."""
    m_hi, m_lo = JUMP_MULTIPLIER >> 32, JUMP_MULTIPLIER & _LOW32

    def low_product(x: Column, m: int) -> Column:
        """The product's value modulo 2**32."""
        upper = F.shiftright(x, 16) * _long(m)
        return ((x.bitwiseAND(0xFFFF)) * _long(m) + F.shiftleft(upper.bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW32)

    small = lo.bitwiseAND(0xFFFF) * _long(m_lo)
    upper = F.shiftright(lo, 16) * _long(m_lo)
    low = small + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + _long(1)
    high = F.shiftright(low, 32) + F.shiftright(upper, 16) + low_product(hi, m_lo) + low_product(lo, m_hi)
    return high.bitwiseAND(_LOW32), low.bitwiseAND(_LOW32)


def jump_shards(key: Column, shards: int) -> Column:
    """struct<shard int, grown_shard int>: the shard among ``shards``, and among
    one more. Both come from one walk, as the walk doesn't depend on the count."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key, _long(0))

    def step(a: Column, _: Column) -> Column:
        hi, lo = _next_state(a["hi"], a["lo"])
        jump = F.floor((a["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            jump.cast("bigint").alias("j"),
            F.when(a["j"] < shards, a["j"]).otherwise(a["at"]).alias("at"),
            a["j"].alias("grown"),
        )
        return F.when(a["j"] < shards + 1, moved).otherwise(a)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(_LOW32).alias("lo"),
        _long(0).alias("j"),
        _long(0).alias("at"),
        _long(0).alias("grown"),
    )
    walk = lambda steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    out = walk(min(shards + 1, FIRST_STEPS))
    if shards + 1 > FIRST_STEPS:  # rows that need more steps take as many as there can be
        out = F.when(out["j"] > shards, out).otherwise(walk(shards + 1))
    return F.struct(out["at"].cast("int").alias("shard"), out["grown"].cast("int").alias("grown_shard"))


def _key_column(df: DataFrame, key: str) -> Column:
    kind = df.schema[key].dataType
    return F.col(key).cast("bigint") if isinstance(kind, T.IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))


def assign_shards(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """Key, size, checksum, law, shard, slot and the shard among one more.

    Only narrow rows are shuffled, never the texts. Slots are gapless in each
    shard: rows are numbered inside (shard, part of the narrow table), and a part's
    first slot is the sum of the counts before it, so that no task holds a shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    picked = df.select(F.col(key), F.octet_length(body).cast("bigint").alias("_size"), F.crc32(body).alias("_crc"), jump_shards(_key_column(df, key), shards).alias("_to"))
    narrow = stash(
        picked.select(
            F.col(key).alias("key"),
            (F.col("_size") + 1).alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.col("_to.shard").alias("shard"),
            F.col("_to.grown_shard").alias("grown_shard"),
            F.spark_partition_id().alias("part"),
        ),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = narrow.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), _long(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("key", "text_crc32", "size")
    return (
        narrow.withColumn("at", F.row_number().over(inside).cast("bigint") - 1)
        .join(first, ["shard", "part"])
        .select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at")).alias("slot"), "grown_shard")
    )
