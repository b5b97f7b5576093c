"""Every registered query against its oracle in DuckDB, over the smallest tables."""

import decimal
import math
import os

import duckdb
import pandas as pd
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if hasattr(v, "item") and not isinstance(v, bytes):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int) and abs(v) < 2**53:
        v = float(v)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else repr(v) if isinstance(v, float) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        assert rows(found) == rows(duck.sql(registry.oracle_sql()[name]).df())
    else:
        assert len(found.columns)


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
