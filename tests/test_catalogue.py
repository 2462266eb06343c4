"""Every catalogued query against its SQL on the smallest tables."""

import duckdb
import pytest

from siftspark.plans import catalogue, stores, workflows  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(name, spark, sf, duck):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).collect()


def test_vector_search_builds_no_index(spark, sf):
    class NoIndex(catalogue.Views):
        @property
        def index(self):
            raise AssertionError("an index for a search by vector")

    assert "similarity" in catalogue._search(NoIndex(spark, sf), "vector").columns
