"""Every registered query with oracle SQL agrees with DuckDB on the sf0.001 tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlark import oracle, workload
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem".split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is None, type(x).__name__, x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(
            f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')"
        )
    return con


ORACLE_KEYS = sorted(oracle.oracle_sql())


@pytest.mark.parametrize("name", ORACLE_KEYS)
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(_norm(x) for x in r) for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    dcols = rel.columns
    assert sorted(df.columns) == sorted(dcols)
    order = [dcols.index(c) for c in df.columns]
    drows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    assert len(srows) == len(drows)
    assert sorted(srows, key=_key) == sorted(drows, key=_key)


def test_every_query_has_oracle():
    assert set(workload.queries()) == set(ORACLE_KEYS)
    assert set(ORACLE_KEYS) <= set(entry.queries()) & set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["vendor_id", "vendor_name", "creditrating"]
