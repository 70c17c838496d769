"""Every registered query against its SQL, row by row."""

import collections
import math

import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SLOW = {"ml_rf_importance", "ml_gbt_metrics", "ml_metrics", "ml_segment_metrics"}


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs_without_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    assert df.columns and len(rows) > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
