"""The queries that have SQL give DuckDB's rows."""

import duckdb
import pytest

from strandframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = c.sql(ORACLES[name])
    at = [want.columns.index(x) for x in cols]
    got = sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
