"""Every registered bar query against its SQL, at the smallest scale."""

import decimal

import duckdb
import pytest

import __spark_entry__
from barlab.plans import ORACLES, QUERIES

TABLES = ("customer", "events", "lineitem", "orders", "supplier")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    rows = con.execute(ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
