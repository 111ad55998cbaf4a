import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import topk
from tesserae.llm.topk import search_block, top_k


def brute(rows, k, asks):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "seeds"), [(8192, 32_768, 4096), (50, 7, 30), (50, 32_768, 3)])
def test_matches_brute_force(spark, monkeypatch, block, chunk, seeds):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "SEEDS", seeds)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * (1 if i % 3 else 0.05)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(20)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 7 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, lambda i: i % 7 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [0.5, -0.001]), (6, [1.0]), (7, [1.0, 2.0]), (8, [3e30, 3e30]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") == 0).collect())
    assert [(r[1], r[2]) for r in got] == [(1, 8), (2, 7), (3, 5)] and got[0][3] == (1 << 63) - 1 and got[1][3] == 256 * 256 * 5
    assert top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_bounds_eliminate():
    """Candidates far from the query, by their distances to pivots, are not evaluated."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(200, 260, (200, 6)), rng.integers(-260, -200, (5000, 6))])
    table = np.sqrt(((x[:, None, :] - x[None, :4, :]) ** 2).sum(axis=2))
    *_, seen = search_block(np.array([0]), x[:1], table[:1], np.arange(len(x)), x, table, 5)
    assert seen < 600


def test_share_evaluated(spark):
    """Clustered vectors: few candidates are evaluated, more pivots leave fewer, and results stay exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 40] + 0.05 * rng.normal(size=16)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shares = {}
    for n in (4, 64):
        got = top_k(df, F.col("vec_id") % 50 == 0, pivots=n, with_share=True).collect()
        assert sorted(tuple(r)[:4] for r in got) == brute(rows, 5, lambda i: i % 50 == 0)
        shares[n] = got[0].evaluated
    assert shares[64] < 0.15 and shares[64] <= shares[4]


def test_vectors_of_several_lengths_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rows = [(i, [1.0, float(i % 3)] if i % 2 else [1.0, float(i % 5), 0.5]) for i in range(90)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 9 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, lambda i: i % 9 == 0)
