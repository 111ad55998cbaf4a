"""Each registered query gives the rows of its DuckDB equivalent."""

import math
import os

import duckdb
import pytest

from tesserae.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, os.environ.get("SF_DIR", SF))
    cur = con.execute(catalog.ORACLES[name])
    cols = sorted(d[0] for d in cur.description)
    names = [d[0] for d in cur.description]
    want = [tuple((dict(zip(names, r, strict=True))[c] is None, plain(dict(zip(names, r, strict=True))[c])) for c in cols) for r in cur.fetchall()]
    assert sorted(df.columns) == cols
    got = [tuple((r[c] is None, plain(r[c])) for c in cols) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
