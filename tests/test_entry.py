"""Queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from textloom.plans.oracle import SQL
from textloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, tuple | list):
        return [plain(y) for y in x]
    return x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = c.sql(SQL[name])
    at = [r.columns.index(x) for x in columns]
    assert sorted(repr(plain([row[x] for x in columns])) for row in df.collect()) == sorted(repr(plain([row[i] for i in at])) for row in r.fetchall())


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
