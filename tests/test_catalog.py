"""The queries against their SQL twins on the smallest tables, if these are there."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str([norm(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    mine = sorted(repr([norm(r[k]) for k in sorted(df.columns)]) for r in df.collect())
    rel = duck.sql(entry.oracle_sql()[name])
    cols = list(rel.columns)
    theirs = sorted(repr([norm(r[cols.index(k)]) for k in sorted(cols)]) for r in rel.fetchall())
    assert sorted(cols) == sorted(df.columns) and mine == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_extraction_stays_in_the_jvm(spark):
    plan = entry.queries()["e09_fuel"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
