import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm.langid import held_out, identified, mixtures, predict, train

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return train(docs.where(~held_out(F.col("doc_id"), 4, 2)))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.where(held_out(F.col("doc_id"), 4, 2)).select("doc_id", "lang").join(predict(docs, model), "doc_id").where("lang_pred != 'und'").collect()
    assert len(rows) > 150
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98


def test_proportions_of_mixed_texts(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 800 and 1500 and lang in ('en', 'de')").orderBy("doc_id")
    en, de = ([r.text for r in docs.where(F.col("lang") == x).limit(6).collect()] for x in ("en", "de"))
    rows = [(i, a[:700] + " " + b[:700]) for i, (a, b) in enumerate(zip(en, de, strict=True))] + [(10 + i, a) for i, a in enumerate(en)]
    got = {r.doc_id: r for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum({"en", "de"} <= set(got[i].langs) for i in range(6)) >= 5
    assert all(0.3 <= got[i].score <= 0.75 for i in range(6))
    assert sum(got[10 + i].langs == ["en"] for i in range(6)) >= 4


def test_mixture_finds_known_proportions():
    rng = np.random.default_rng(1)
    truth = (rng.random(600) < 0.25).astype(int)
    like = np.where(np.arange(3)[None, :] == truth[:, None], -1.0, -6.0) + rng.normal(0, 0.3, (600, 3))
    share, chosen = mixtures(like.astype(np.float32), np.repeat([0, 2], [400, 200]), 3)
    assert chosen.tolist() == [[True, True, False], [False] * 3, [True, True, False]]
    assert abs(share[0, 1] - truth[:400].mean()) < 0.03


def test_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 ... !!", "x"), (None, "the and of this is", "x"), (4, "Ж", "x"), (5, "the and of this is " * 40_000, "x"), (5, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in predict(df, model).collect()]
    assert len(got) == 7 and {g[0] for g in got if g[1] == "und"} == {1, 2, 3}
    assert all(0 <= g[2] <= 1 for g in got) and (None, "en") in {g[:2] for g in got}
    assert predict(df.limit(0), model).count() == 0
    assert train(df.limit(0).withColumn("lang", F.lit("a"))) is None
    assert {r.lang_pred for r in predict(df, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    words = {f"l{i:02}": [word() for _ in range(12)] for i in range(70)}
    text = lambda x: " ".join(rng.choice(words[x], 40))
    # the later a language, the fewer its texts: the last of 70 has one
    rows = [(i * 100 + k, text(x), x) for i, x in enumerate(words) for k in range(70 - i)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(words) and model.step < 1 << 20
    asked = ["l00", "l40", "l63", "l64", "l66", "l69"]
    got = predict(spark.createDataFrame([(i, text(x)) for i, x in enumerate(asked)], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == asked


def test_clean_text_in_three_languages_stays(spark):
    rng = np.random.default_rng(4)
    face = {"x": "abcdefg", "y": "hijklmn", "z": "opqrstu"}
    text = lambda x, n: " ".join("".join(rng.choice(list(face[x]), 7)) for _ in range(n))
    model = train(spark.createDataFrame([(i * 3 + k, text(x, 300), x) for i in range(5) for k, x in enumerate(face)], "doc_id long, text string, lang string"))
    rows = [(1, " ".join(text(x, 200) for x in face)), (2, text("x", 200)), (3, "123"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    assert got[1].langs == ["x", "y", "z"] and got[1].score < 0.35
    assert sorted(r.doc_id for r in identified(docs, model).collect()) == [1, 2]
