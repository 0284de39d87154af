"""Shared folder, written tables and column helpers of the operators."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), or a folder of
    this machine's own where the session names none and runs on this machine alone, as
    in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    cuts the lineage, survives lost executors and compresses better than a
    checkpoint of rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(*written: DataFrame) -> None:
    """Delete tables of ``stash`` that nothing reads any more. What was made of them must
    have been written before."""
    for df in written:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of text whose words meet in one bucket, about.
BUCKET_BYTES = 32 << 20


def buckets_for(df: DataFrame, text_col: str) -> int:
    """How many buckets of words a table's texts make, a shuffle's partitions at least."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), total // BUCKET_BYTES + 1)


#: Bytes that are sent to Python at once.
BATCH_BYTES = 4 << 20


def small_batches(f: Callable) -> Callable:
    """For functions of (DataFrame, ...) that run all jobs with long texts or sets before
    they return: meanwhile a batch sent to Python has at most BATCH_BYTES, or one row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kwargs):
        conf = df.sparkSession.conf
        before = conf.get(key)
        conf.set(key, str(BATCH_BYTES))
        try:
            return f(df, *args, **kwargs)
        finally:
            conf.set(key, before)

    return run
