"""Line-oriented record files: factorizations and compositions, read and written with
Spark's text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EXON = r"^(\d+) (\d+) (\d+) (\d+)(?: (\S+) (\S+))?\s*$"


def read_factorizations(spark: SparkSession, path: str) -> DataFrame:
    """est_id, fact_no, polya, polyad, exons (S05): the file is cut at '>'; consecutive
    records of one id are its alignments, in order."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    lines = F.split(F.col("value"), "\n")
    flag = lambda name: F.coalesce(F.nullif(F.regexp_extract("value", rf"#{name}=(\d)", 1), F.lit("")).cast("int") == 1, F.lit(False))
    number = lambda x, i: F.regexp_extract(x, _EXON, i).cast("int")
    exon = lambda x: F.struct(number(x, 1).alias("est_start"), number(x, 2).alias("est_end"), number(x, 3).alias("gen_start"), number(x, 4).alias("gen_end"), F.regexp_extract(x, _EXON, 5).alias("est_seq"), F.regexp_extract(x, _EXON, 6).alias("gen_seq"))
    exons = F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.rlike(_EXON)), exon)
    parsed = rows.select("at", F.element_at(lines, 1).alias("est_id"), flag("polya").alias("polya"), flag("polyad").alias("polyad"), exons.alias("exons"))
    from pyspark.sql import Window

    return parsed.withColumn("fact_no", F.row_number().over(Window.partitionBy("est_id").orderBy("at"))).drop("at")


def factorization_text(rows: DataFrame, externals: bool = True) -> DataFrame:
    """A record of each row as text (K02); without ``externals`` the first exon goes,
    and the last one unless it has a poly-A tail."""
    last = F.size("exons") - F.when(F.col("polya"), 0).otherwise(1)
    kept = F.col("exons") if externals else F.slice("exons", F.lit(2), F.greatest(last - 1, F.lit(0)))
    line = lambda e: F.concat_ws(" ", e["est_start"], e["est_end"], e["gen_start"], e["gen_end"], F.nullif(e["est_seq"], F.lit("")), F.nullif(e["gen_seq"], F.lit("")))
    flag = lambda c: F.concat(F.lit(f"#{c}="), F.col(c).cast("int"))
    head = F.concat_ws("\n", F.concat(F.lit(">"), F.col("est_id")), flag("polya"), flag("polyad"))
    return rows.select("est_id", "fact_no", F.concat_ws("\n", head, F.array_join(F.transform(kept, line), "\n")).alias("value"))


def write_factorizations(rows: DataFrame, path: str, externals: bool = True) -> None:
    """Alignments of an id follow each other in the file."""
    factorization_text(rows, externals).sortWithinPartitions("est_id", "fact_no").select("value").write.text(path)


def edge_table(edge_rows: DataFrame, intron: int = 50) -> DataFrame:
    """Graph edges with a flag for those that span an intron."""
    return edge_rows.withColumn("intronic", (F.col("t2") - F.col("t1")) - (F.col("p2") - F.col("p1")) >= intron)


def read_cds_annotations(spark: SparkSession, path: str | None) -> DataFrame:
    """Optional annotated coding regions (S09): no rows without a path."""
    schema = "refseq string, rel_start int, rel_end int, sequence string"
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).option("sep", "\t").csv(path)
