"""Every registered query of the engine against its SQL, in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from edgeloom import catalogue

DATA = os.environ.get("CATALOGUE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(c[0] for c in want.description) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == rows
