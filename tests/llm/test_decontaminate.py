import itertools
import random
import re

import pytest

from tesserae.llm import decontaminate
from tesserae.llm.decontaminate import ITEM_WORDS, MASKS, SHORT_MASKS, WINDOW, clean, overlaps


def brute(docs, items, window=13):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        a = split(t)
        for i, s in items:
            b = split(s)
            if len(b) < 5:
                continue
            w = min(window, len(b))
            for shift in range(-len(b) + 1, len(a)):
                eq = [int(0 <= j + shift < len(a) and a[j + shift] == b[j]) for j in range(len(b))]
                for j in range(len(b) - w + 1):
                    m = sum(eq[j : j + w])
                    if m * 100 >= w * 80:
                        out[d, i] = min(out.get((d, i), (0, 0, 0, 0)), (-m, j + shift, j, w))
    return sorted((d, i, -m, w, at, j) for (d, i), (m, at, j, w) in out.items())


@pytest.mark.parametrize("n", range(ITEM_WORDS, WINDOW + 1))
def test_every_allowed_pattern_has_a_seed(n):
    masks = MASKS if n == WINDOW else MASKS + SHORT_MASKS
    for m in range(n * 20 // 100 + 1):
        for changed in itertools.combinations(range(n), m):
            assert any(all(p + k not in changed for k, c in enumerate(mask) if c == "1") for mask in masks for p in range(n - len(mask) + 1)), changed


@pytest.mark.parametrize("limit", [4 << 20, 0])
def test_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 7, 9, 10, 11, 14, 30])))) for i in range(25)]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(40)))]
        if rng.random() < 0.7:
            w = rng.choice(items)[1].split()
            for k in range(len(w)):
                if rng.random() < 0.12:
                    w[k] = "zz"
            parts += [", ".join(w[rng.randrange(3) :]).upper(), rng.choice(vocab)]
        docs.append((d, " ".join(parts)))
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, items)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None, 0), (2, "", 0), (3, "x " * 90_000 + item, 0), (3, item, 0), (None, item.upper(), 0), (4, "one two", 0)]
    items = [(1, item, 0), (1, item, 0), (2, None, 0), (3, "", 0), (4, "one two", 0), (None, "x x x x x x", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, words int").withColumnRenamed("words", "item")
    b = spark.createDataFrame(items, "item_id long, text string, seed int")
    got = {(r.doc_id, r.item_id): (r.matched, r.doc_start) for r in overlaps(d, b).collect()}
    assert got == {(3, 1): (10, 0), (None, 1): (10, 0), (3, None): (6, 0)}
    assert overlaps(d.limit(0), b).count() == 0 and overlaps(d, b.limit(0)).count() == 0


def test_clean_judges_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "x " + item, 0), (None, item, 0), (None, "a text of its own", 0), (2, item, 0), (2, "another of its own", 0), (3, None, 0), (4, "", 0), (5, "kept twice", 0), (5, "kept twice", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = clean(d, b)
    assert got.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(0, "a text of its own"), (2, "another of its own"), (3, ""), (4, ""), (5, "kept twice"), (5, "kept twice")])
    assert clean(d.limit(0), b).count() == 0 and clean(d, b.limit(0)).count() == len(rows)
