"""Every query with SQL gives DuckDB's rows; the others run and keep their columns."""

import math

import duckdb
import pytest

from splicework.plans import driver_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = driver_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return x.item() if hasattr(x, "item") else x


def rows(frame, columns):
    return sorted(repr(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(driver_queries.queries()))
def test_query(spark, duck, name):
    got = driver_queries.queries()[name](spark, DATA).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
