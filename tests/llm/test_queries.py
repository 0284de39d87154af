"""The registered queries: SQL, native plans and the pipeline."""

import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from splicework.llm import queries
from splicework.llm.common import stash

DATA = "/root/testdata/sf0.001"


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", ["op1_shards", "op4_chat", "op10_url_rules"])
def test_native(spark, name):
    plan = queries.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "InArrow"))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0


def test_registered():
    assert {*queries.queries(), "pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_stages(spark):
    """Each stage keeps the columns, only takes rows away, and its decision is the
    operator's."""
    from splicework.llm import decontaminate, near_dup, quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    decide = {
        "quality_rules": lambda d: quality.judge(d).filter("kept"),
        "near_duplicates": lambda d: near_dup.near_duplicates(d).filter("kept"),
        "repeated_passages": lambda d: d,
        "decontamination": lambda d: decontaminate.decontaminate(d, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("NOT contaminated"),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = {r["doc_id"] for r in decide[name](docs).select("doc_id").collect()}
        docs_after = stash(stage(spark, docs, DATA), name)
        assert docs_after.columns == docs.columns
        assert {r["doc_id"] for r in docs_after.select("doc_id").collect()} == want
        assert docs_after.filter("n_chars != length(text)").count() == 0
        docs = docs_after
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert tokens.count() == docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, tokens.collect()))


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, other columns, and no rows at all."""
    long = " ".join(f"w{i}" for i in range(80))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id int, key string"
    rows = [(1, None, None, None, None, 1, "k"), (2, "", "en", "s", 0, 1, "k"), (None, long, "en", "s", len(long), 1, "k"), (3, long, "en", "s", len(long), 1, "k"), (3, long, "en", "s", len(long), 1, "k")]
    for name, data in (("some", rows), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(path)
        docs = spark.read.parquet(path)
        for step, stage in corpus_pipeline.STAGES[:-1]:
            docs = stash(stage(spark, docs, DATA), step)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
        assert len(out) == (1 if data else 0)


def test_library_stands_alone():
    top = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, names in os.walk(f"{top}/splicework"):
        if "llm" in folder.split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(f"{folder}/{n}") as f:
                    assert "llm" not in f.read()
