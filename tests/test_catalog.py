"""The queries of the catalog give what DuckDB gives; those that rank for many iterations are left to the driver's comparison."""

from pathlib import Path

import duckdb
import pytest

from strataweave.plans import catalog

DATA = Path("/root/testdata/sf0.001")
SLOW = {"focus", "impact", "tour", "project_map", "view_rows", "backbone", "focus_30", "top_files", "personal_pagerank_10"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = duck.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall()))) == sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect())))


def test_all_are_registered():
    import __spark_entry__

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(__spark_entry__.queries())
