"""Texts as flat byte arrays: the numpy side shared by the text operators.

A batch of texts becomes one ``uint8`` array and the offsets of each text in it, so that
hashing words, shingles or byte windows is a few vector operations for a whole batch and
costs no Python object per word.  All hashes are 64-bit and wrap around.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bases of the two polynomial hashes and the multipliers of the finaliser (odd constants).
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
#: Bytes of text that one vector step takes; a longer text makes a step of its own.
STEP_BYTES = 2 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of each 64-bit value over all its bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(MIX_1)
    h ^= h >> U64(27)
    h *= U64(MIX_2)
    h ^= h >> U64(31)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, and of its inverse modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=U64))
        known = (out[0], out[1])
        if size <= 8 * STEP_BYTES:
            _powers[base] = known
    return known


class Poly:
    """Hashes of any byte ranges of a buffer, each in constant time."""

    def __init__(self, buf: np.ndarray, base: int) -> None:
        up, self.down = powers(base, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=self.sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]


def release() -> None:
    """Give memory that a finished partition used back to the system: workers are used again."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins and ends. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            end = min(batch.num_rows, max(end, at + 1))
            yield batch.slice(at, end - at)
            at = end
    release()


#: A-Z become a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that part words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of each word of a buffer; words never span two texts."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~IS_SPACE[buf]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    edges = off[(off > 0) & (off < n)]
    begin[edges] = ink[edges]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    end[edges - 1] = ink[edges - 1]
    b = np.flatnonzero(begin)
    return b, np.flatnonzero(end) + 1, np.searchsorted(off, b, side="right") - 1


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct `size`-word shingles of each text, A-Z lower-cased.

    Returns the hashes sorted within each text, the text number of each, and the number per
    text.  A text of fewer words (but at least one) has its whole word sequence as one.
    """
    n_texts = len(off) - 1
    buf = LOWER[buf]
    b, e, text = words(buf, off)
    if not len(b):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(n_texts, np.int64)
    word = mix(Poly(buf, BASE_A)(b, e) ^ (e - b).astype(U64))
    per = np.bincount(text, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(per)))[:-1]
    length = np.minimum(per, size)
    n_per = np.where(per > 0, per - length + 1, 0)
    owner = np.repeat(np.arange(n_texts), n_per)
    start = np.repeat(first, n_per) + np.arange(len(owner)) - np.repeat(np.cumsum(n_per) - n_per, n_per)
    size_of = length[owner]
    h = np.full(len(owner), BASE_B, U64) * size_of.astype(U64)
    for k in range(size):
        more = size_of > k
        if more.all():
            h = mix(h * U64(BASE_A) + word[start + k])
        else:
            at = np.flatnonzero(more)
            h[at] = mix(h[at] * U64(BASE_A) + word[start[at] + k])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, owner, np.bincount(owner, minlength=n_texts)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from all its values in turn and the number in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
