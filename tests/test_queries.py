"""Every query with SQL agrees with DuckDB as a multiset; the corpus queries are tested in tests/llm."""

import datetime
import glob
import os

import duckdb
import pytest

from runstore.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = [os.path.basename(p)[:-8] for p in glob.glob(f"{SF}/*.parquet")]


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def multiset(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 1000 and len(set(got)) == len(got)
        return
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(duck.sql(sql).columns) == columns
    assert multiset(got) == multiset(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
