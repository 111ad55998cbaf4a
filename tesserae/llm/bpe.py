"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Encoding.  An Aho-Corasick automaton over the vocabulary gives the longest token at a
position.  A token may follow another only if the merge rules would not have joined or cut
them differently; that is read off the split of each token into its two merge parts, and
remembered in a pair-compatibility table.  Where no token that starts here is compatible
with the one before, the encoder steps back, and a position found to be a dead end is never
tried again, so the work is linear in the text.  The result is exactly that of applying the
merges one by one.

Decoding.  The bytes of all tokens lie in one array; an offset table says where each begins,
and a whole batch of ids is decoded by one gather.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import steps

#: Words up to this length are remembered, and at most so many of them, in each worker.
WORD_CHARS, WORDS = 64, 1 << 17
#: Remembered answers about token pairs, in each worker.
PAIRS = 1 << 17
#: Bytes of text encoded in one step.
STEP = 2 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, the other way round.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the
    code points from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE vocabulary, read from a tokenizer file in JSON."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("only byte-level BPE without a normalizer, prefix space or post-processor is supported")
        spell = lambda token: bytes(letters[c] for c in token)
        ids: dict[bytes, int] = {spell(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or want whole words are not supported")
        # rank order: single bytes first, then tokens in the order of their merges
        merges = [tuple(spell(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.rank_of = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.spelled: list[bytes] = [bytes([b]) for b in range(256)]
        self.joins: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair, token = (self.rank_of[a], self.rank_of[b]), a + b
            rank = self.rank_of.get(token)
            if rank is None:
                rank = self.rank_of[token] = len(self.parts)
                self.parts.append(pair)
                self.spelled.append(token)
            self.joins.setdefault(pair, rank)
        self.id_of = [ids[t] for t in self.spelled]
        self.id_bytes = [i.to_bytes(4, "little") for i in self.id_of]
        self.pairs = _Pairs(self)
        self.specials = specials
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        #: The public pattern that parts a text into words before merging.
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        # a token that its own merges would cut otherwise is never the answer
        self.good = [self._stands(r) for r in range(len(self.parts))]
        self.matcher = ahocorasick.Automaton()
        self.shorter: list[int] = [-1] * len(self.parts)
        for r, t in enumerate(self.spelled):
            if self.good[r]:
                self.matcher.add_word(t.decode("latin-1"), r)
        self.matcher.make_automaton()
        for r, t in enumerate(self.spelled):
            for n in range(len(t) - 1, 0, -1):
                p = self.rank_of.get(t[:n])
                if p is not None and self.good[p]:
                    self.shorter[r] = p
                    break
        self.words = _Words(self)
        size = max([*ids.values(), *specials.values()]) + 1
        texts = [b""] * size
        for t, i in [*ids.items(), *((s.encode(), i) for s, i in specials.items())]:
            texts[i] = t
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def _stands(self, rank: int) -> bool:
        a, b = self.parts[rank]
        return rank < 256 or self.joins.get((a, b)) == rank and self.compatible(a, b, rank)

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether two neighbouring tokens stay apart under the merge rules.

        Walks the seam between them from the last merges down to single bytes.  A pair on
        the seam that merges earlier than the later-made of its two sides would have been
        joined first.  `below`: the pair itself may merge into this token.  `pairs` remembers
        the answers.
        """
        limit = below if below is not None else len(self.parts)
        a, b = left, right
        while True:
            joined = self.joins.get((a, b))
            if joined is not None and joined < limit:
                return False
            # undo whichever of the two was made later; then only earlier merges could clash
            if a > b:
                limit = a
                a = self.parts[a][1]
                if a == limit:  # a single byte: nothing left to undo on this side
                    limit = b + 1
                    b = self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.parts[a][1]
                    if a == limit:
                        return True

    def word_ids(self, word: bytes) -> bytes:
        """Packed token ids of one word.

        One walk of the automaton gives the longest token at the start, at its end, and so on.
        Up to the first pair that isn't compatible these are the answer; from there on the
        encoder steps back.
        """
        text, pairs = word.decode("latin-1"), self.pairs
        longest = [r for _, r in self.matcher.iter_long(text)]
        for i, pair in enumerate(zip(longest, longest[1:], strict=False)):
            if not pairs[pair]:
                return self._stepped_back(text, longest[: i + 1], longest[i + 1])
        return b"".join([self.id_bytes[t] for t in longest])

    def _stepped_back(self, text: str, taken: list[int], token: int) -> bytes:
        """Packed token ids of a text whose first tokens are `taken` and whose next longest is `token`."""
        n, pairs = len(text), self.pairs
        dead = bytearray(n + 1)
        at = sum(len(self.spelled[t]) for t in taken)
        while True:
            before = taken[-1] if taken else -1
            while token >= 0:
                end = at + len(self.spelled[token])
                if not dead[end] and (before < 0 or pairs[before, token]):
                    break
                token = self.shorter[token]
            if token >= 0:
                taken.append(token)
                at = end
                if at == n:
                    return b"".join([self.id_bytes[t] for t in taken])
                token = next(self.matcher.iter_long(text, at))[1]
            else:
                dead[at] = 1
                last = taken.pop()
                at -= len(self.spelled[last])
                token = self.shorter[last]

    def packed(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        if self.special_split is not None and any(s in text for s in self.specials):
            return b"".join(self.specials[p].to_bytes(4, "little") if p in self.specials else self._plain(p) for p in self.special_split.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.word.findall(text)))

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of packed ids."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        begin = self.offset[ids]
        size = self.offset[ids + 1] - begin
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        out = self.blob[np.repeat(begin - (after - size), size) + np.arange(total)].tobytes()
        ends = np.concatenate(([0], after))[np.cumsum([len(p) // 4 for p in packed])] if packed else []
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class _Pairs(dict):
    """The pair-compatibility table, filled as it is asked."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        ok = self[pair] = self.encoder.compatible(*pair)
        return ok


class _Words(dict):
    """Packed ids of words, filled as they are asked for.

    Words that were asked for since the last ageing but one stay, so common words outlive rare ones.
    """

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self.encoder.word_ids(word.encode())
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once per worker."""
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, back: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in steps(batches, "text", STEP):
        packed = [enc.packed(t or "") for t in batch.column("text").to_pylist()]
        cols = [batch.column("doc_id"), pa.array(packed, pa.binary())]
        if back:
            cols.append(pa.array([b.decode("utf-8", "replace") for b in enc.decode(packed)], pa.string()))
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in steps(batches, "ids", STEP):
        out = enc.decode([x or b"" for x in batch.column("ids").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b.decode("utf-8", "replace") for b in out], pa.string())], names=["doc_id", "decoded"])


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, as packed little-endian 32-bit integers.

    Special tokens that stand in a text as such become their ids.  Null texts are empty and
    have no ids; ids that repeat, or are null, each keep their row; other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_encode, path=path, back=False), "doc_id long, ids binary")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids); bytes that are no UTF-8 become U+FFFD. Null ids: empty."""
    return ids.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): encode, then decode the ids, in one pass over the texts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_encode, path=path, back=True), "doc_id long, ids binary, decoded string")
