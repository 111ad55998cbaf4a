"""Language identification as inference over a multilingual mixture.

A document is taken as a mixture of languages.  Its text is cut into units of a few words;
each unit has a likelihood under each language, from byte trigrams counted in labelled text.
Expectation-maximisation estimates the proportions of the languages in the document, for the
best one, the best two, and so on; the set of languages with the best penalised likelihood
is selected, and the prediction is its largest part.

Trigrams are counted on a bounded sample: for each language about `per_lang` documents,
chosen by a hash of their ids.  Everything else sees every whole text.  Every language that
labelled text names is learned, however few its texts.  Their number is bounded nowhere, so
counts reach the driver for a block of languages at a time, and texts are cut into smaller
steps where there are more languages than a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import flat, steps
from .storage import kept, scratch

#: Trigrams are counted in so many cells, a power of two.
CELLS = 1 << 16
#: Labelled documents from which a language's trigrams are counted, about; the sample's bound.
PER_LANG = 2000
#: Languages whose counts are fetched at once; a step of texts is as large as so many languages allow.
BLOCK = 64
#: Bytes of a unit, about, and rounds of expectation-maximisation.
UNIT_BYTES, ROUNDS = 40, 12
#: Weight of half the logarithm of the number of units for each further language.
PENALTY = 4.0
#: Trigrams of one unit are not independent: their joint log-likelihood is tempered by this.
TEMPER = 0.25
STEP = 1 << 20

LETTER = regex.compile(r"\p{L}")
#: Bytes as the model sees them: a-z and bytes of other scripts stay, A-Z become a-z, the rest is a space.
FACE = np.full(256, 32, np.uint8)
FACE[97:123] = np.arange(97, 123)
FACE[65:91] = np.arange(97, 123)
FACE[128:] = np.arange(128, 256)


def cells(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The cell of the trigram that begins at each byte; behind the end of its text there are spaces."""
    x = np.full(len(buf) + 2, 32, np.uint32)
    x[: len(buf)] = FACE[buf]
    second, third = x[1:-1].copy(), x[2:].copy()
    ends = off[1:][np.diff(off) > 0]
    second[ends - 1] = third[ends - 1] = 32
    third[ends[ends > 1] - 2] = 32
    h = (x[:-2] << 16 | second << 8 | third) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - CELLS.bit_length() + 1)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", STEP):
        buf, off = flat(batch.column("text"))
        number = np.repeat(batch.column("number").to_numpy().astype(np.int64), np.diff(off))
        both, n = np.unique(number * CELLS + cells(buf, off), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((both // CELLS).astype(np.int32)), pa.array((both % CELLS).astype(np.int32)), pa.array(n)], names=["number", "cell", "n"])


class Model:
    """Log-likelihoods of trigram cells under each language, 256 KB a language."""

    def __init__(self, langs: list[str]) -> None:
        self.langs = langs
        self.log_p = np.zeros((CELLS, len(langs)), np.float32)

    def learn(self, first: int, counts: np.ndarray) -> None:
        """Take the counts (languages x cells) of the languages from number `first` on."""
        smooth = counts + 0.5
        self.log_p[:, first : first + len(counts)] = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T

    @property
    def step(self) -> int:
        """Bytes of text to take at once."""
        return max(1, STEP * BLOCK // max(BLOCK, len(self.langs)))

    def units(self, cell: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log-likelihoods of the units that begin at these places (units x langs), a few bytes at a time."""
        out = np.zeros((len(begins), len(self.langs)), np.float32)
        ends = np.append(begins[1:], len(cell))
        at = 0
        while at < len(begins):
            to = max(at + 1, int(np.searchsorted(ends, begins[at] + self.step, side="right")))
            lo = begins[at]
            out[at:to] = np.add.reduceat(self.log_p[cell[lo : ends[to - 1]]], begins[at:to] - lo, axis=0)
            at = to
        return out


def train(labelled: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learn from rows (doc_id, text, lang) with text and lang; None if there are none."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return None
    langs = sorted(r["lang"] for r in sizes)
    part = {r["lang"]: min(1.0, per_lang / r["count"]) for r in sizes}
    numbers = known.sparkSession.createDataFrame([(x, i, part[x]) for i, x in enumerate(langs)], "lang string, number int, part double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.join(F.broadcast(numbers), "lang").where(draw < F.col("part")).select("text", "number")
    model = Model(langs)
    with scratch(known.sparkSession):
        counted = chosen.mapInArrow(_tally, "number int, cell int, n long").groupBy("number", "cell").agg(F.sum("n").alias("n"))
        if len(langs) > BLOCK:
            counted = kept(counted, "trigrams")
        for first in range(0, len(langs), BLOCK):
            size = min(BLOCK, len(langs) - first)
            got = counted.where(F.col("number").between(first, first + size - 1)).toArrow()  # at most BLOCK * CELLS rows
            counts = np.zeros((size, CELLS))
            counts[got["number"].to_numpy() - first, got["cell"].to_numpy()] = got["n"].to_numpy()
            model.learn(first, counts)
    return model


def mixtures(like: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each document, and which languages were selected.

    `like` holds the log-likelihood of each unit under each language, `doc` its document.
    """
    n_lang = like.shape[1]
    units = np.bincount(doc, minlength=n_docs)
    some = np.flatnonzero(units)
    starts = (np.cumsum(units) - units)[some]
    total = lambda x: np.add.reduceat(x, starts, axis=0)
    share = np.zeros((n_docs, n_lang))
    chosen = np.zeros((n_docs, n_lang), bool)
    if not len(some):
        return share, chosen
    local = np.repeat(np.arange(len(some)), units[some])
    top = like.max(axis=1, keepdims=True)
    rel = np.exp(like - top)
    flat_top = total(top[:, 0].astype(np.float64))
    alone = total(like.astype(np.float64))
    best_ll = alone.max(axis=1)
    pick = np.zeros((len(some), n_lang), bool)
    pick[np.arange(len(some)), alone.argmax(axis=1)] = True
    mix = pick.astype(np.float64)
    cost = PENALTY * 0.5 * np.log(units[some] + 1.0)
    score = best_ll - cost
    # no mixture beats the sum of the best language of each unit: where that isn't enough, one language is final
    open_ = np.flatnonzero(flat_top - 2 * cost > score)
    if n_lang > 1 and len(open_):
        keep = np.isin(local, open_)
        _, again = np.unique(local[keep], return_inverse=True)
        r, n = rel[keep], units[some][open_]
        at = np.cumsum(n) - n
        pi = np.full((len(open_), n_lang), 1.0 / n_lang)
        allowed = np.ones((len(open_), n_lang), bool)
        for size in range(n_lang, 1, -1):
            for _ in range(ROUNDS):
                w = r * pi[again]
                s = w.sum(axis=1, keepdims=True)
                pi = np.add.reduceat(w / np.maximum(s, 1e-300), at, axis=0) / n[:, None]
            ll = flat_top[open_] + np.add.reduceat(np.log(np.maximum((r * pi[again]).sum(axis=1), 1e-300)), at)
            better = ll - size * cost[open_] > score[open_]
            score[open_] = np.where(better, ll - size * cost[open_], score[open_])
            mix[open_[better]] = pi[better]
            pick[open_[better]] = allowed[better]
            # the least language goes
            least = np.where(allowed, pi, np.inf).argmin(axis=1)
            allowed[np.arange(len(open_)), least] = False
            pi = np.where(allowed, np.maximum(pi, 1e-3), 0)
            pi /= pi.sum(axis=1, keepdims=True)
    # how sure the choice of the largest part is: posterior of the languages taken alone
    e = np.exp(np.minimum(0, alone - best_ll[:, None]))
    sure = e / e.sum(axis=1, keepdims=True)
    single = pick.sum(axis=1) == 1
    mix[single] = np.where(pick[single], sure[single], 0)
    share[some], chosen[some] = mix, pick
    return share, chosen


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", model.step):
        pred, score, langs = infer(batch.column("text"), model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string()))], names=["doc_id", "lang_pred", "score", "langs"])


def infer(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Prediction, score and selected languages of each text."""
    names = np.array([*model.langs, "und"], object)
    buf, off = flat(texts)
    n = len(off) - 1
    size = np.diff(off)
    letters = np.zeros(n, bool)
    ascii_letter = np.concatenate(([0], np.cumsum(np.isin(FACE[buf], np.arange(97, 123)))))
    letters[ascii_letter[off[1:]] > ascii_letter[off[:-1]]] = True
    for i in np.flatnonzero(~letters & (size > 0)):
        letters[i] = LETTER.search(texts[i].as_py()) is not None
    # units begin at the first word begin in each stretch of UNIT_BYTES
    face = FACE[buf]
    word = np.ones(len(buf), bool)
    word[1:] = (face[1:] != 32) & (face[:-1] == 32)
    begins = np.flatnonzero(word)
    owner = np.searchsorted(off, begins, side="right") - 1
    slot = (begins - off[owner]) // UNIT_BYTES
    first = np.ones(len(begins), bool)
    first[1:] = (slot[1:] != slot[:-1]) | (owner[1:] != owner[:-1])
    begins = np.unique(np.concatenate((begins[first], off[:-1][size > 0])))
    doc = np.searchsorted(off, begins, side="right") - 1
    like = model.units(cells(buf, off), begins) * np.float32(TEMPER)
    share, chosen = mixtures(like, doc, n)
    best = share.argmax(axis=1)
    pred = np.where(letters, best, len(model.langs))
    score = np.where(letters, np.clip(share[np.arange(n), best], 0, 1), 0.0)
    langs = [sorted(names[:-1][c]) if ok else [] for c, ok in zip(chosen, letters, strict=True)]
    return names[pred].tolist(), score, langs


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, langs) for every row of docs.

    lang_pred is the language with the largest part, score its proportion of the document
    (for a document of one language, how sure that language is), langs the selected set.
    Null texts and texts without a letter, or all texts if there is no model, are `und`, with
    score 0.  Repeated and null ids keep their rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("langs"))
    return docs.mapInArrow(partial(_predict, model=model), "doc_id long, lang_pred string, score double, langs array<string>")


def _keep(batches: Iterator[pa.RecordBatch], model: Model, text_col: str, least: float) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, text_col, model.step):
        pred, score, langs = infer(batch.column(text_col), model)
        yield batch.filter(pa.array([p != "und" and (len(x) > 1 or s >= least) for p, s, x in zip(pred, score, langs, strict=True)], pa.bool_()))


def identified(docs: DataFrame, model: Model | None, *, text_col: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language.

    Rows go whose prediction is `und`, or for which one language is selected that is less than
    `least` sure.  Where several are selected the text has those, however it is shared among
    them.  Without a model there are no languages, and no rows stay.
    """
    if model is None:
        return docs.limit(0)
    return docs.mapInArrow(partial(_keep, model=model, text_col=text_col, least=least), docs.schema)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
