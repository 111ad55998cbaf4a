"""Each query with an oracle gives the oracle's rows."""

import math

import duckdb
import pytest

from tesserae.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(registry.ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = [dict(zip(cols, r, strict=True)) for r in cur.fetchall()]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    key = lambda r: tuple((r[c] is None, plain(r[c]) if r[c] is not None else 0) for c in sorted(cols))
    assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, want))
    assert want
