"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridmark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in registry.ORACLE:
        cur = con.execute(registry.ORACLE[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        want = [tuple(map(plain, r)) for r in cur.fetchall()]
        assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str) == sorted(want, key=str)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.n == r.conforme + r.non_conforme + r.manquant + r.ajoute


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
