import random

import numpy as np
import pytest

from tesserae.llm import suffix
from tesserae.llm.suffix import repeated_passages, suffix_order


def brute(rows, width):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def corpus(seed, n=80):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([60, 99, 100, 101, 140, 300]))) for _ in range(8)]
    line = "a common line of some forty-eight bytes, always"
    rows = []
    for i in rng.sample(range(1000), n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(rng.choice(passages))
            elif kind < 0.5:
                p = rng.choice(passages)
                parts.append(p[rng.randrange(len(p)) :])
            elif kind < 0.7:
                parts.append(line)
            elif kind < 0.8:
                parts.append("xy" * rng.randrange(20, 120))
            parts.append("".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(0, 120))))
        rows.append((i, "".join(parts)))
    return rows + [(2000 + k, rows[k][1]) for k in range(10)]


@pytest.mark.parametrize(("seed", "crowded"), [(1, 8192), (2, 3), (3, 1), (4, 8192), (5, 1)])
def test_matches_brute_force(spark, seed, crowded, monkeypatch):
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    rows = corpus(seed)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == brute(rows, 100)


def test_suffix_order_is_lexicographic_within_a_phase():
    rng = random.Random(3)
    for _ in range(30):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(100, 260))) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.5:
            parts.append(parts[0])
        parts.append(b"ab" * 110)
        raw = b"".join(parts)
        size = np.array([len(p) for p in parts])
        first = np.cumsum(size) - size
        ends = np.repeat(first + size, size)
        phase = (np.arange(len(raw)) - np.repeat(first + 7, size)) % suffix.V
        chosen = np.concatenate([f + np.arange(s - 99) for f, s in zip(first, size, strict=True)])
        got = suffix_order(np.frombuffer(raw, np.uint8), ends, phase, chosen, chosen % 2, 100)
        key = lambda i: (i % 2, raw[i : i + suffix.V], phase[i], raw[i : i + 100])  # noqa: B023, E731
        assert [key(i) for i in got] == sorted(key(i) for i in chosen) and sorted(got) == sorted(chosen)


def test_odd_rows(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(200_000))
    rows = [(1, None, 1), (2, "", 1), (3, "short", 1), (4, "z" * 250, 1), (None, "q" * 120, 1), (7, "q" * 120, 1), (8, long, 1), (9, long, 1), (11, "k1" * 80, 1), (11, "k1" * 80, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = {}
    for r in repeated_passages(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, len(r.spans)))
    assert got[1] == [(0, 0, 0)] and got[2] == [(0, 0, 0)] and got[3] == [(5, 0, 0)]
    assert got[4] == [(250, 249, 1)] and got[7] == [(120, 120, 1)] and got[None] == [(120, 119, 1)]
    assert got[9] == [(200_000, 200_000, 1)] and len(got[11]) == 2
    assert repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 3])
def test_texts_under_one_id_are_places_of_their_own(spark, doc_id):
    rng = random.Random(6)
    fresh = "".join(rng.choice("abcdefghij") for _ in range(600))
    line = "".join(rng.choice("klmnop") for _ in range(205))
    df = spark.createDataFrame([(doc_id, line + line), (doc_id, fresh), (9, fresh)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in repeated_passages(df).collect()}
    assert got == {(doc_id, 410): 205, (doc_id, 600): 0, (9, 600): 600}
    kept = {(r.doc_id, r.text) for r in suffix.without_repeats(df).collect()}
    assert kept == {(doc_id, line), (doc_id, fresh), (9, "")}
