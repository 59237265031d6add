"""Every registered query of the engine against its SQL, run by DuckDB on the same tables."""

import math

import duckdb
import pytest

from wickerframe.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, sf, name):
    got = queries.queries()[name](spark, sf)
    sql = oracle.oracle_sql().get(name)
    assert sql, name
    want = duck.sql(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
