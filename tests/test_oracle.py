"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from phaselens.plans import oracle, registry
from phaselens.sources.readers import DRIVER_TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    body = sorted((tuple(_norm(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((x is None, str(x)) for x in t))
    return [cols[i] for i in order], body


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        path = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert len(registry.queries()) >= 68


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    res = duck.execute(oracle.oracle_sql()[name])
    ours = _canon(df.columns, [tuple(r) for r in df.collect()])
    theirs = _canon([d[0] for d in res.description], res.fetchall())
    assert ours == theirs


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["business_phase", "total_orders", "total_revenue", "revenue_in_crores", "avg_order_value"]
    assert df.count() == 3
