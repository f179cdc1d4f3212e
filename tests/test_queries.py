"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    found = [tuple(r) for r in got.collect()]
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, found) == rows(names, want.fetchall())


def test_entry(spark):
    assert len(entry.entry(spark).columns) > 0
