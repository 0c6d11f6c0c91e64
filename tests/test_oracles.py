"""Every query of the library against its SQL in another engine."""

import math
import os

import duckdb
import pytest

from lumetra.plans import catalog, file_catalog  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    held = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in held.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows, "a query without rows compares nothing"
    assert rows == sorted((tuple(plain(v) for v in r) for r in held.fetchall()), key=str)


def test_acceptance_has_samples_on_both_sides(spark, duck):
    kept = catalog.QUERIES["sample_acceptance_stated"](spark, DATA).count()
    assert 0 < kept < duck.execute("SELECT count(DISTINCT p_partkey % 8) FROM part").fetchone()[0]
