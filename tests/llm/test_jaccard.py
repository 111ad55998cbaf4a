import random
import re

import numpy as np
import pytest

from tesserae.llm.jaccard import jaccard_components


def brute(rows, size, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    ids = [r[0] for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                comp[root(i)] = root(j)
    low = {}
    for i in range(len(rows)):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), low[root(i)]) for i in range(len(rows)))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [rng.choice(vocab)]
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 11, 14, 20, 40, 90, 200])))
        texts.append(text)
        rows.append((i * 3 % 1009, text if rng.random() < 0.8 else text.upper().replace(" ", "\n\t")))
    return rows


@pytest.mark.parametrize(("seed", "size", "num", "den"), [(1, 3, 90, 100), (2, 5, 80, 100), (3, 1, 70, 100)])
def test_matches_brute_force(spark, seed, size, num, den):
    rows = corpus(seed)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size, threshold=(num, den)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, size, num, den)


def test_odd_rows(spark):
    rows = [(5, None, 1), (6, "", 2), (7, " \n\t ", 3), (8, "one", 4), (9, "ONE", 5), (9, "ONE", 6), (10, "x " * 50000, 7), (None, "alone here", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s1 long")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == {(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (10, 1, 10), (None, 1, None)}
    assert jaccard_components(df).count() == len(rows)
    assert jaccard_components(df.limit(0)).count() == 0


def test_many_near_copies_in_blocks(spark, monkeypatch):
    import tesserae.llm.jaccard as m

    monkeypatch.setattr(m, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_bands_reach_the_largest_sets(monkeypatch, num, den):
    import tesserae.llm.jaccard as m

    made, plain = [], m.Bands
    monkeypatch.setattr(m, "Bands", lambda *a: made.append(plain(*a)) or made[-1])
    list(m._features(iter([]), 3, num, den))
    (bands,) = made
    for size in (1000, 1 << 24, 1 << 27, (1 << 31) - 1):
        (band,) = bands.band(np.array([size]))
        # linked sets of this band and of the next have a segment more than they can differ in
        assert bands.segments[band] > (size + size * den // num) * (den - num) // (den + num)
