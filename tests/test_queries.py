"""Every registered query with SQL gives DuckDB's rows at the smallest scale; all have stable schemas."""

from __future__ import annotations

import duckdb
import pytest

from foliant.plans import catalogue, etl, fetch, pages, search  # noqa: F401

NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def same(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    got = sorted((tuple(same(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(df.columns) == sorted(want.columns)
        assert got == sorted((tuple(same(r[i]) for i in order) for r in want.fetchall()), key=repr)
