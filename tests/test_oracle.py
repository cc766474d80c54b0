"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from tesserae import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(rows: list[tuple]) -> Counter:
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return Counter(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    got = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == columns
    listed = [got.columns.index(c) for c in columns]
    want = plain([tuple(r[i] for i in listed) for r in got.fetchall()])
    have = plain([tuple(r) for r in rows])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
    assert rows or name == "fil_06_isolated"
