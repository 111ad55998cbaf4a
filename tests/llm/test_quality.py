import numpy as np
from pyspark.sql import functions as F

from tesserae.llm.langid import held_out
from tesserae.llm.quality import DEPTH, FEATURES, fit, score, statistics, train

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forest = train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    rows = score(docs, forest).join(labels.where(held_out(F.col("doc_id"), 5, 0)), "doc_id").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert len(rows) > 500 and auc > 0.95
    assert np.mean((s >= 0.3) == y) > 0.93


def test_flat_arrays_walk_like_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.5)).astype(float)
    forest = fit(x, y)
    assert np.mean((forest.score(x) > 0.5) == y) > 0.97
    for row in x[:50]:
        total = forest.base
        for at in forest.roots:
            for _ in range(DEPTH):
                at = forest.left[at] + (row[forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        assert abs(1 / (1 + np.exp(-total)) - forest.score(row[None])[0]) < 1e-12


def test_statistics_of_small_texts():
    parts = [b"", b"One two two.\nOne two two.\n", b"!!!", "é".encode()]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    x = statistics(buf, np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
    at = FEATURES.index
    assert x.shape == (4, len(FEATURES)) and np.isfinite(x).all() and not x[0].any() or x[0, at("repeated_bigrams")] == 1
    assert x[1, at("distinct_lines")] == 0.5 and np.isclose(x[1, at("distinct_words")], 3 / 6) and x[2, at("symbol")] == 1 and x[3, at("non_ascii")] == 1


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "x" * 400_000, 1), (3, "w " * 100_000, 1)] + [(10 + i, "fine words here. " * (i + 1), 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(10, 40)] + [(None, 1, 1), (1, None, 1), (2, 7, 1)], "doc_id long, quality int, toxic int")
    got = score(df, train(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert train(df, labels.limit(0)) is None and score(df.limit(0), None).count() == 0
