"""The queries of this subpackage that SQL can say, against DuckDB."""

import pytest

from termweave.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)
