"""The corpus pipeline: documents through five of the training-data operators.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicework.llm import bpe, decontaminate, near_dup, passages, quality, suffix_dedup
from splicework.llm.common import stash, table
from splicework.llm.queries import tokenizer


#: A column that no document has.
ROW = "__pipeline_row"


#: The workers of this stage still hold their memory when others start, so its chunks are small.
CHUNK_BYTES = 3 << 20


def _row_named(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row, in the column ROW. Rows of Parquet
    files are numbered by file and place, so that nothing is written; others are written
    with their numbers."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{ROW}_file"), F.col("_metadata.row_index").alias(f"{ROW}_index"))
        # as many names as the scan itself lists
        files = sorted(r[0] for r in placed.select(f"{ROW}_file").distinct().collect())
    except AnalysisException:
        return stash(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    named = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"`{ROW}_file` string, `{ROW}_number` bigint")
    number = (F.col(f"{ROW}_number") * (1 << 40) + F.col(f"{ROW}_index")).alias(ROW)
    return placed.join(F.broadcast(named), f"{ROW}_file").select(*docs.columns, number)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and aren't outliers of their group."""
    numbered = _row_named(docs)
    kept = quality.judge(numbered, id_col=ROW).filter("kept").select(ROW)
    return numbered.join(kept, ROW, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of near-duplicates."""
    numbered = _row_named(docs)
    order = numbered.select(F.col(ROW), F.col("doc_id"))
    classes = near_dup.near_duplicates(numbered, id_col=ROW).select(ROW, "class_id")
    least = order.join(classes, ROW).groupBy("class_id").agg(F.min(F.struct("doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return numbered.join(least, ROW, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur twice and the passages of over 50 words
    that several documents have, both of the texts as they come; the count of characters
    follows. A document that is nothing but repeats stays, with what is left."""
    numbered = _row_named(docs)
    cut = suffix_dedup.remove_repeats(numbered, id_col=ROW, also=passages.passages(numbered, ROW, "text"))
    kind = docs.schema["n_chars"].dataType
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    numbered = _row_named(docs)
    report = decontaminate.decontaminate(numbered, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return numbered.join(report.filter("NOT contaminated").select(ROW), ROW, "left_semi").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded bytes."""
    return bpe.digests(docs, *tokenizer(), chunk_bytes=CHUNK_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", contaminated),
    ("tokens", tokens),
]

#: The stages rest on estimates and on ties that SQL can't state; they are tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
