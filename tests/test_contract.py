"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.plans import contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(contract.ORACLE))
def test_query_matches_sql(spark, sf, duck, name):
    got = contract.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    cursor = duck.execute(contract.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want, names = table(cursor.fetchall(), columns)
    have, own = table(rows, got.columns)
    assert own == names and len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if any(isinstance(x, float) for x in a) else a == b


@pytest.mark.parametrize("name", sorted(set(contract.QUERIES) - set(contract.ORACLE)))
def test_other_queries_run(spark, sf, name):
    assert contract.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
