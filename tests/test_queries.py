"""Every query against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from lamella import queries as core

ORACLES = core.ORACLE_SQL


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, tiny, name):
    df = core.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = duck.sql(ORACLES[name])
    assert sorted(sql.columns) == cols
    at = [sql.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in sql.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
