"""Queries of the subpackage that have SQL, against DuckDB on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from tesserae.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF).select(*got.columns)
    assert sorted(map(tuple, df.collect())) == sorted(got.fetchall())
