"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import collections
import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SLOW = {"stream_fold", "run_grid", "run_sma_crossover"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v if v is None or isinstance(v, (str, bool, int)) else str(v).removesuffix(" 00:00:00")


def bag(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    want = duck.sql(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(got, df.columns) == bag(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, DATA).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
