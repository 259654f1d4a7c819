"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from noctiluca.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = tables.execute(catalog.ORACLES[name])
    there = [c[0] for c in want.description]
    assert sorted(there) == columns
    assert got == Counter(tuple(plain(r[there.index(c)]) for c in columns) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["map_by_components", "map_by_neighbours", "hashed_embeddings", "all_recommendations", "sample_collection", "sample_collection_perfect"])
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
