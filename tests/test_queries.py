"""Every registered query against its SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from deltascope import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:19].removesuffix(" 00:00:00")
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.6f}"
    return f"{float(x):.6f}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda names, data: sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
