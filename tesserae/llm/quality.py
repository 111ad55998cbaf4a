"""Document quality by histogram gradient-boosted trees.

Each whole text becomes a row of statistics.  Trees are grown on binned statistics by
gradient histograms, and all trees are then laid out in flat arrays (feature, threshold, left
child, value), so that scoring a batch is a few numpy gathers per level of the trees.

Training takes a bounded sample of labelled rows (`sample` rows at most, chosen by a hash of
their ids); scoring sees every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASE_A, LOWER, U64, Poly, flat, mix, steps, words

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST_ROWS, RIDGE = 64, 80, 4, 0.15, 8, 1.0
STEP = 1 << 20

FEATURES = (
    "log_words", "mean_word", "long_words", "short_words", "upper", "digit", "punct", "symbol", "space", "non_ascii",
    "distinct_words", "top_word", "repeated_bigrams", "log_lines", "distinct_lines", "mean_line", "end_marks", "upper_words", "max_word", "mean_repeat",
)

_UPPER, _DIGIT, _PUNCT, _SYMBOL, _SPACE, _WIDE = range(6)
_CLASSES = np.full(256, 6, np.int64)
_CLASSES[65:91] = _UPPER
_CLASSES[48:58] = _DIGIT
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = _PUNCT
_CLASSES[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = _SYMBOL
_CLASSES[[32, *range(9, 14)]] = _SPACE
_CLASSES[128:] = _WIDE


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each text has, and how often its most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate((at, [len(v)])))
    most = np.zeros(n)
    np.maximum.at(most, o[at], size)
    return np.bincount(o[at], minlength=n).astype(float), most


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(off) - 1
    size = np.diff(off)
    owner_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner_byte * 7 + _CLASSES[buf], minlength=7 * n).reshape(n, 7).astype(float)
    share = kinds / np.maximum(size, 1)[:, None]
    b, e, owner = words(buf, off)
    length = (e - b).astype(float)
    count = np.bincount(owner, minlength=n).astype(float)
    per = np.maximum(count, 1)
    by = lambda x: np.bincount(owner, weights=x, minlength=n)
    poly = Poly(LOWER[buf], BASE_A)
    h = mix(poly(b, e)) if len(b) else np.zeros(0, U64)
    kinds_of_words, top = _distinct(owner, h, n)
    pair = (owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
    two = mix(h[:-1] * U64(BASE_A) + h[1:])[pair] if len(h) else np.zeros(0, U64)
    kinds_of_pairs, _ = _distinct(owner[1:][pair], two, n)
    pairs = np.maximum(np.bincount(owner[1:][pair], minlength=n) if len(owner) else np.zeros(n), 1)
    # lines: texts are cut at line feeds and at their own ends
    cut = np.flatnonzero(buf == 10)
    line_b = np.sort(np.concatenate((off[:-1][size > 0], cut + 1)))
    line_b = np.unique(line_b[line_b < len(buf)])
    line_e = np.concatenate((line_b[1:], [len(buf)])) if len(line_b) else line_b
    line_of = np.searchsorted(off, line_b, side="right") - 1
    lines = np.bincount(line_of, minlength=n).astype(float)
    line_kinds, line_top = _distinct(line_of, mix(poly(line_b, line_e)) if len(line_b) else np.zeros(0, U64), n)
    last = buf[e - 1] if len(e) else buf[:0]
    first = buf[b] if len(b) else buf[:0]
    longest = np.zeros(n)
    if len(owner):
        np.maximum.at(longest, owner, length)
    out = [
        np.log1p(count), by(length) / per, by(length > 12) / per, by(length <= 2) / per, share[:, _UPPER], share[:, _DIGIT], share[:, _PUNCT], share[:, _SYMBOL], share[:, _SPACE], share[:, _WIDE],
        kinds_of_words / per, top / per, 1 - kinds_of_pairs / pairs, np.log1p(lines), line_kinds / np.maximum(lines, 1), size / np.maximum(lines, 1), by(np.isin(last, [46, 63, 33])) / per, by((first >= 65) & (first <= 90)) / per, np.log1p(longest), line_top / np.maximum(lines, 1),
    ]
    return np.stack(out, axis=1)


@dataclass
class Forest:
    """All trees in flat arrays: node i of a tree goes to `left[i]`, or to the one after it."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                # leaves point to themselves: left[i] == i and an infinite threshold
                at = self.left[at] + (x[rows, self.feature[at]] > self.threshold[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost trees for the logistic loss on histograms of binned statistics."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    f = np.full(n, base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        todo = [(roots[-1], np.arange(n), 0)]
        while todo:
            at, rows, depth = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            value[at] = -RATE * sg / (sh + RIDGE)
            best = (1e-6, -1, -1)
            if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
                cell = (binned[rows] + np.arange(m) * BINS).ravel()
                hg, hh, hn = (np.bincount(cell, weights=np.repeat(w, m), minlength=m * BINS).reshape(m, BINS).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = hg**2 / (hh + RIDGE) + (sg - hg) ** 2 / (sh - hh + RIDGE) - sg**2 / (sh + RIDGE)
                gain[(hn < LEAST_ROWS) | (len(rows) - hn < LEAST_ROWS)] = -1
                j, k = np.unravel_index(int(gain.argmax()), gain.shape)
                best = max(best, (float(gain[j, k]), int(j), int(k)))
            if best[1] < 0:
                f[rows] += value[at]
                continue
            _, j, k = best
            goes_left = binned[rows, j] <= k
            a, b = node(), node()
            feature[at], threshold[at], left[at] = j, float(edges[j][k]), a
            todo += [(a, rows[goes_left], depth + 1), (b, rows[~goes_left], depth + 1)]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), base)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", STEP):
        x = statistics(*flat(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = SAMPLE) -> Forest | None:
    """Learn from docs (doc_id, text) and labels (doc_id, 0 or 1); None if no row is labelled.

    Null ids, null labels and labels other than 0 and 1 are not used.  Above `sample` labels,
    a part of them is chosen by a hash of the id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / n))
    # one more limit, on top of the expected number, so the bound is certain
    used = known.where(draw).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(used), "doc_id").mapInArrow(_statistics, "doc_id long, label int, x array<double>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))


def _score(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", STEP):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(forest.score(statistics(*flat(batch.column("text")))))], names=["doc_id", "score"])


def score(docs: DataFrame, forest: Forest | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs: how likely label 1 is, from 0 to 1.

    Null texts count as empty, and empty texts are scored like others.  Without a model every
    score is 0.5.  Repeated and null ids keep their rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if forest is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    return docs.mapInArrow(partial(_score, forest=forest), "doc_id long, score double")
