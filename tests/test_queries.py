"""Every query against its SQL on the smallest tables; those without SQL must run and have a stable schema."""

import importlib

import pytest

import __spark_entry__ as entry

PLANS = [importlib.import_module(m) for m in entry.MODULES]
QUERIES = {n: q for m in PLANS for n, q in m.QUERIES.items()}
SQL = {n: s for m in PLANS for n, s in m.SQL.items()}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
