"""Every query with SQL beside it gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from quillon.plans import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i]) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in got)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
