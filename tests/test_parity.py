"""Every query with SQL against DuckDB over the small tables."""

import math
from pathlib import Path

import pytest

from termweave.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())
