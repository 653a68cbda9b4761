"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from fungo.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_parity(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    result = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    order = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    names = result.columns
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in order]) for r in result.fetchall())
    assert got == want
