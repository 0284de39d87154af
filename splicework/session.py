"""What operators ask of the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or one of this machine's own where none is set
    and the session runs on this machine alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the folder of ``_checkpoint_dir``."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as a Parquet table beside the checkpoints, which takes less disk than a
    checkpoint of rows. ``by``: columns whose values get folders of their own."""
    path = f"{_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """``df`` whose columns ``names`` the optimizer doesn't write out again for each use, as
    it may not copy what depends on the row's number. For arrays that are rebuilt step by
    step, and looked at many times in each."""
    return df.withColumns({c: F.when(F.monotonically_increasing_id() >= 0, F.col(c)) for c in names})
