"""Corpus queries that SQL can express, held against it on whole tables."""

import os

import duckdb
import pytest

from gristmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", ORACLES)
def test_parity(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = c.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    want = sorted(result.fetchall())
    assert sorted(map(tuple, df.select(*columns).collect())) == want and want
