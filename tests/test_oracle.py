"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
CORE = {k: v for k, v in entry.queries().items() if v.__module__.startswith("tessera.plans")}


def same(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(same, value))
    return value


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def views(root):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(root)):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{root}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_sql(spark, root, views, name):
    frame = CORE[name](spark, root)
    columns = sorted(frame.columns)
    got = sorted((tuple(same(row[c]) for c in columns) for row in frame.collect()), key=key)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    relation = views.sql(sql)
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(same(row[i]) for i in order) for row in relation.fetchall()), key=key)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
