"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

from quotemill.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in found.collect())
    out = db.execute(queries.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(text(r[names.index(c)]) for c in columns) for r in out.fetchall()) and got
