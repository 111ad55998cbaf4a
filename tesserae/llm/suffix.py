"""Suffix-array removal of repeated passages: exact, block by block, in bounded memory.

A byte goes if it lies in a `width`-byte string that also starts earlier in the corpus
(smaller doc_id, or the same document further left).

Places.  A row is (doc_id, sub): sub is 0 for an id that one row has, else a hash of the row's
text, so texts under one id, or under null, are different places.

Buckets.  A suffix belongs to the bucket named by the least-hashing `GRAM`-byte string among
its first `width` bytes, the leftmost of equals.  Suffixes that agree on `width` bytes have
the same bucket, so buckets can be sorted one at a time, anywhere.  Consecutive suffixes with
one and the same such place form a *run*; only runs are shipped, some 40 bytes of text each.

1. Runs that are wholly equal are settled by their hash: all but the first go, first within
   each step's texts, then over the corpus.
2. Buckets that hold one run are done: nothing in them repeats.
3. Of the other buckets, the text of each remaining run is fetched, and the suffixes of a
   block of buckets are sorted by difference cover.  Positions count from the place of the
   bucket's gram, so suffixes that agree on `width` bytes have the same phase modulo V.
   Sample positions, whose phase is in the cover, are ranked first; suffixes are then sorted
   by bucket and their first V bytes, and ties of one phase are resolved by the ranks of the
   next sample positions.  (Ties of different phases differ further on, and their order
   doesn't matter.)  Neighbours that agree on `width` bytes are repeats, and the first of
   each group by (doc_id, sub, start) stays.
4. A bucket that exceeds a block is split first.  Its runs are cut into classes of `CLASS`
   suffixes by their place from the gram; all suffixes of a class share width - CLASS + 1 bytes
   around the gram, whose hash names the new bucket.  Where even such a bucket exceeds a block,
   its suffixes differ in CLASS - 1 bytes at most: those bytes are the key of a last, radix
   step, by which the first of each group is found without a sort.

What is first in a group is always a minimum that tasks combine before the shuffle; groups are
joined to their first by a join that adaptive execution splits, and no window holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import BASE_A, BASE_B, U64, Poly, flat, mix, release, signed, steps
from .storage import drop, kept, scratch

#: Bytes of the strings that name buckets.
GRAM = 24
#: A difference cover: every number modulo V is a difference of two of COVER.
V, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of text whose buckets are sorted at once, and the runs that they hold, about.
BLOCK_BYTES, CROWDED = 1 << 20, 2048
#: Suffixes of a class, where a bucket exceeds a block.
CLASS = 8
#: Rows that are broadcast at most.
BROADCAST_ROWS = 200_000
LOWEST = -(1 << 63)


def least_grams(buf: np.ndarray, hashes: Poly, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a `width`-byte string, the place of its least-hashing gram; the gram hashes."""
    n = len(buf) - GRAM + 1
    at = np.arange(n)
    gram = mix(hashes(at, at + GRAM))
    packed = (gram & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    span, have = width - GRAM + 1, 1
    low = packed
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return (low & U64(0xFFFFFFFF)).astype(np.int64), gram


def runs(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Text number, start, number of suffixes, gram's place from the start, bucket and content hash of each run."""
    if len(buf) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, U64) for _ in range(2))
    a = Poly(buf, BASE_A)
    place, gram = least_grams(buf, a, width)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(place)]
    inside = np.arange(len(place)) + width <= off[text + 1]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    end = inside.copy()
    end[:-1] &= ~inside[1:] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    lo, hi = np.flatnonzero(begin), np.flatnonzero(end)
    p = place[lo]
    content = mix(Poly(buf, BASE_B)(lo, hi + width) + mix(((p - lo) << 32 | (hi - lo)).astype(U64)))
    return text[lo], lo - off[text[lo]], hi - lo + 1, p - lo, gram[p], content


def ranks(doc: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each place (doc, sub), equal for equal ones, and where each rank is first met."""
    order = np.lexsort((sub, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (sub[order][1:] != sub[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


def later(groups: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks what is not the first by (doc, start) among rows alike in all of `groups`."""
    order = np.lexsort((start, doc, *groups))
    same = np.ones(len(order), bool)
    if len(order):
        same[0] = False
    for g in groups:
        g = g[order]
        same[1:] &= g[1:] == g[:-1]
    d, s = doc[order], start[order]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = np.zeros(len(order), bool)
    out[order] = (d != d[head]) | (s != s[head])
    return out


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite intervals of each document that touch or overlap."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    _, group = np.unique(doc, return_inverse=True)
    lift = group * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + lift)
    new = np.ones(len(doc), bool)
    new[1:] = lo[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(doc)])) - 1
    return doc[at], lo[at], reach[last] - lift[at]


_RUN = ["doc_id", "sub", "start", "n", "place", "bucket", "content"]
_OUT = "doc_id long, sub long, start long, n long, place int, bucket long, content long"


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs that may be first (with bucket), and intervals of bytes to remove (without)."""
    for batch in steps(batches, "text"):
        buf, off = flat(batch.column("text"))
        text, start, n, place, bucket, content = runs(buf, off, width)
        ids, subs = (batch.column(c).to_numpy() for c in ("doc_id", "sub"))
        rank, at = ranks(ids, subs)
        doc = rank[text]
        gone = later([content, bucket], doc, start)
        d, lo, hi = merged(doc[gone], start[gone], (start + n)[gone] + width - 1)
        stay = ~gone
        t = text[stay]
        yield pa.RecordBatch.from_arrays([pa.array(ids[t]), pa.array(subs[t]), pa.array(start[stay]), pa.array(n[stay]), pa.array(place[stay].astype(np.int32)), signed(bucket[stay]), signed(content[stay])], names=_RUN)
        if len(d):
            none = pa.nulls(len(d), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[d]]), pa.array(subs[at[d]]), pa.array(lo), pa.array(hi - lo), pa.nulls(len(d), pa.int32()), none, none], names=_RUN)


_CUT = "doc_id long, sub long, start long, n long, place int, bucket long, size long, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes that each wanted run of a text spans."""
    for batch in batches:
        texts, wanted, ids, subs = (batch.column(c) for c in ("text", "runs", "doc_id", "sub"))
        rows = []
        for i in range(batch.num_rows):
            view = memoryview(texts[i].as_buffer() if texts[i].is_valid else b"")
            place = ids[i].as_py(), subs[i].as_py()
            rows += [(*place, r["start"], r["n"], r["place"], r["bucket"], r["size"], bytes(view[r["start"] : r["start"] + r["n"] + width - 1])) for r in wanted[i].as_py()]
        kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]
        cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "sub", "start", "n", "place", "bucket", "size", "bytes"])


def _grid(buf: np.ndarray, at: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each position as big-endian words, zero behind the end of its text; buf is padded."""
    rows = np.lib.stride_tricks.sliding_window_view(buf, n)[at]
    short = np.flatnonzero(ends - at < n)
    if len(short):
        rows[short] = np.where(np.arange(n) < (ends - at)[short][:, None], rows[short], 0)
    return rows.view(">u8").astype(U64)


def _named(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1, equal for equal keys; the last key leads."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def suffix_order(buf: np.ndarray, ends: np.ndarray, phase: np.ndarray, chosen: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """The chosen suffixes in order of (group, first V bytes, phase, the rest up to `width` bytes).

    For each position, `ends` is where its text ends and `phase` its place from the gram,
    modulo V.  `group` are the buckets of the chosen positions.
    """
    n = len(buf)
    pad = np.concatenate((buf, np.zeros(V + 1, np.uint8)))
    cover = np.isin(np.arange(V), COVER)
    sample = np.flatnonzero(cover[phase])
    w = _grid(pad, sample, np.minimum(ends[sample], sample + V), 32)
    name = _named([w[:, 3], w[:, 2], w[:, 1], w[:, 0]])
    rank = np.zeros(n + 1, np.int64)
    known = V
    while known < width:  # double the bytes that the ranks cover; a multiple of V further on is the same phase
        rank[sample] = name
        on = sample + known
        name = _named([np.where(on < ends[sample], rank[np.minimum(on, n)], 0), name])
        known *= 2
    rank[sample] = name
    to_sample = np.array([next(k for k in range(V) if cover[(i + k) % V]) for i in range(V)])
    on = chosen + to_sample[phase[chosen]]
    tail = np.where(on < ends[chosen], rank[np.minimum(on, n)], 0)
    w = _grid(pad, chosen, np.minimum(ends[chosen], chosen + V), 32)
    return chosen[np.lexsort((tail, phase[chosen], w[:, 3], w[:, 2], w[:, 1], w[:, 0], group))]


def repeats(parts: list[bytes], n: np.ndarray, place: np.ndarray, bucket: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the suffixes of these runs that also start earlier in the same bucket."""
    buf = np.frombuffer(b"".join(parts), np.uint8)
    size = n + width - 1
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    chosen = first[owner] + inner
    ends = np.repeat(first + size, size)
    phase = (np.arange(len(buf)) - np.repeat(first + place, size)) % V
    order = suffix_order(buf, ends, phase, chosen, bucket[owner], width)
    back = np.searchsorted(chosen, order)
    o, d, s = owner[back], doc[owner[back]], (start[owner] + inner)[back]
    # neighbours that agree on `width` bytes, tested on the bytes themselves
    same = np.zeros(len(order), bool)
    rows = np.arange(1, len(order))
    rows = rows[bucket[o[1:]] == bucket[o[:-1]]]
    strings = np.lib.stride_tricks.sliding_window_view(buf, width)
    for cut in range(0, len(rows), 1 << 14):
        r = rows[cut : cut + (1 << 14)]
        same[r] = (strings[order[r]] == strings[order[r - 1]]).all(axis=1)
    gone = later([np.cumsum(~same)], d, s)
    return d[gone], s[gone]


_GONE = "doc_id long, sub long, lo long, hi long"


def _sorted_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sort the suffixes of whole buckets, as many at a time as fit a block."""
    hold: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        doc, sub, start, n, place, bucket = (np.array([h[k] for h in hold], np.int64) for k in range(6))
        rank, at = ranks(doc, sub)
        d, s = repeats([h[6] for h in hold], n, place, bucket, rank, start, width)
        d, lo, hi = merged(d, s, s + width)
        return pa.RecordBatch.from_arrays([pa.array(doc[at[d]]), pa.array(sub[at[d]]), pa.array(lo), pa.array(hi)], names=["doc_id", "sub", "lo", "hi"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "sub", "start", "n", "place", "bucket", "bytes")]
        for row in zip(*cols, strict=True):
            if hold and held >= BLOCK_BYTES and row[5] != hold[-1][5]:
                yield flush()
                hold.clear()
                held = 0
            hold.append(row)
            held += len(row[6])
    if hold:
        yield flush()
    hold.clear()
    release()


_PIECE = "doc_id long, sub long, start long, n long, place int, bucket long, content long, bytes binary"


def _classes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs of crowded buckets, cut into classes, with the bucket and the content hash of each piece."""
    for batch in steps(batches, "bytes"):
        buf, off = flat(batch.column("bytes"))
        doc, sub, start, n, place, bucket = (batch.column(c).to_numpy() for c in ("doc_id", "sub", "start", "n", "place", "bucket"))
        # the suffix i of a run stands place - i before the gram; classes count down from the first
        top, low = place // CLASS, (place - n + 1) // CLASS
        many = top - low + 1
        of = np.repeat(np.arange(len(n)), many)
        c = top[of] - (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
        lo = np.maximum(place[of] - (c * CLASS + CLASS - 1), 0)
        hi = np.minimum(place[of] - c * CLASS, n[of] - 1)
        at = off[:-1][of] + lo
        poly = [Poly(buf, b) for b in (BASE_A, BASE_B)]
        core = off[:-1][of] + place[of] - c * CLASS  # where the bytes begin that all suffixes of the class have
        name = mix(poly[0](core, core + width - CLASS + 1) ^ mix(bucket.view(U64)[of] + c.view(U64)))
        content = mix(poly[1](at, off[:-1][of] + hi + width) + mix(((c << 32) + (place[of] - lo) * CLASS + (hi - lo)).view(U64)))
        raw = buf.tobytes()
        out = [raw[a : a + k] for a, k in zip(at.tolist(), (hi - lo + width).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[of]), pa.array(sub[of]), pa.array(start[of] + lo), pa.array(hi - lo + 1), pa.array((place[of] - lo).astype(np.int32)), signed(name), signed(content), pa.array(out, pa.binary())],
            names=["doc_id", "sub", "start", "n", "place", "bucket", "content", "bytes"],
        )


def _edges(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """What tells the suffixes of a crowded class apart: the bytes beside the core that all share.

    Repeats within a step go at once (without `edge`).
    """
    names = ["doc_id", "sub", "lo", "hi", "bucket", "edge"]
    for batch in steps(batches, "bytes"):
        buf, off = flat(batch.column("bytes"))
        doc, sub, start, n, place, bucket = (batch.column(c).to_numpy() for c in ("doc_id", "sub", "start", "n", "place", "bucket"))
        owner = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        before = (place % CLASS)[owner] - inner  # bytes of the suffix in front of the core
        at = off[:-1][owner] + inner
        edge = before.astype(U64)
        for k in range(CLASS - 1):  # the bytes in front of the core, then those behind it
            skip = np.where(k >= before, width - CLASS + 1, 0)
            edge = (edge << U64(8)) | buf[at + k + skip].astype(U64)
        rank, first = ranks(doc, sub)
        r, s, b = rank[owner], start[owner] + inner, bucket[owner]
        gone = later([edge, b], r, s)
        d, lo, hi = merged(r[gone], s[gone], s[gone] + width)
        stay = ~gone
        o = owner[stay]
        yield pa.RecordBatch.from_arrays([pa.array(doc[o]), pa.array(sub[o]), pa.array(s[stay]), pa.array(s[stay] + width), pa.array(b[stay]), signed(edge[stay])], names=names)
        none = pa.nulls(len(d), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc[first[d]]), pa.array(sub[first[d]]), pa.array(lo), pa.array(hi), none, none], names=names)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column("doc_id")
        texts, gone = batch.column("text"), batch.column("gone")
        size, lost, spans, out = [], [], [], []
        for i in range(batch.num_rows):
            raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
            cuts = gone[i].as_py() or []
            at, parts, found = 0, [], []
            for lo, hi in sorted((c["lo"], min(c["hi"], len(raw))) for c in cuts):
                if found and lo <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], hi)
                elif lo < hi:
                    found.append([lo, hi])
            for lo, hi in found:
                parts.append(raw[at:lo])
                at = hi
            parts.append(raw[at:])
            size.append(len(raw))
            lost.append(sum(hi - lo for lo, hi in found))
            spans.append([{"lo": lo, "hi": hi} for lo, hi in found])
            out.append(b"".join(parts))
        kinds = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays([doc, pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, kinds), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _rewrite(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Cut the texts; a character that loses some of its bytes goes whole. Then drop the intervals."""
    for batch in batches:
        part = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col), batch.column("__gone")], names=["doc_id", "text", "gone"])
        out = next(_apply(iter([part])))
        texts = pa.array([None if not t.is_valid else k.as_py().decode("utf-8", "ignore") for t, k in zip(batch.column(text_col), out.column("kept"), strict=True)], batch.column(text_col).type)
        keep = [c for c in batch.schema.names if c != "__gone"]
        yield pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(c) for c in keep], names=keep)


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with its places, (__doc, __sub): only ids that several rows have are told apart by text."""
    docs = docs.withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)))
    again = kept(docs.groupBy("__doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("__doc", F.lit(True).alias("__again")), "repeated", lasting=True)
    n = again.count()
    if not n:
        return docs.withColumn("__sub", F.lit(0).cast("long"))
    told = docs.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, "__doc", "left")
    return told.withColumn("__sub", F.when(F.col("__again"), F.xxhash64(F.col(id_col).isNull(), F.col(text_col).cast("string"))).otherwise(F.lit(0).cast("long"))).drop("__again")


def _with_gone(placed: DataFrame, text_col: str, width: int) -> DataFrame:
    """The rows with __gone, the intervals to remove."""
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    gone = removed_intervals(placed.select(F.col("__doc").alias("doc_id"), F.col("__sub").alias("sub"), F.col(text_col).cast("string").alias("text")), width)
    listed = gone.groupBy(F.col("doc_id").alias("__doc"), F.col("sub").alias("__sub")).agg(F.collect_list(F.struct("lo", "hi")).alias("__gone"))
    return placed.join(listed, ["__doc", "__sub"], "left")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, their texts without repeated passages.

    The same bytes go as in `repeated_passages`, with its rules for nulls, repeats and ties; null
    texts stay null, and an empty table gives an empty one.
    """
    rows = _with_gone(_placed(docs, id_col, text_col), text_col, width).select(*docs.columns, "__gone")
    return rows.mapInArrow(partial(_rewrite, text_col=text_col), docs.schema)


def removed_intervals(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, sub, lo, hi): byte intervals to remove, for docs (doc_id, sub, text) without null places."""
    with scratch(docs.sparkSession):
        return kept(_intervals(docs, width), "removed", lasting=True)


def _firsts(rows: DataFrame, group: list[str], place: list[str]) -> DataFrame:
    """For each group its first row's place, and how many rows it has."""
    return rows.groupBy(*group).agg(F.min(F.struct(*place)).alias("first"), F.count(F.lit(1)).alias("c"))


def _is_first(place: list[str]) -> Column:
    return F.struct(*place) == F.struct(*[F.col(f"first.{p}").alias(p) for p in place])


def _intervals(docs: DataFrame, width: int) -> DataFrame:
    place = ["doc_id", "sub", "start"]
    span = lambda rows, last: rows.select("doc_id", "sub", F.col("start").alias("lo"), (F.col("start") + F.col("n") + last).alias("hi"))
    rows = kept(docs.mapInArrow(partial(_runs, width=width), _OUT), "runs")
    done = [kept(span(rows.where("bucket is null"), 0), "gone")]
    found = rows.where("bucket is not null")
    shared = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    common = kept(found.join(shared, "bucket"), "common")
    drop(rows)
    firsts = kept(common.groupBy("bucket", "content").agg(F.min(F.struct(*place, "n", "place")).alias("first"), F.count(F.lit(1)).alias("c")), "firsts")
    copies = common.join(firsts.where("c > 1").drop("c"), ["bucket", "content"]).where(~_is_first(place))
    done.append(kept(span(copies, width - 1), "gone"))
    drop(common)
    open_ = firsts.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    leads = firsts.join(open_, "bucket").select("first.*", "bucket", "size")
    wanted = kept(leads.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "n", "place", "bucket", "size")).alias("runs")), "wanted")
    drop(firsts)
    few = wanted.count() <= BROADCAST_ROWS and wanted.select(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "sub"]).select("doc_id", "sub", "text", "runs")
    cut = kept(texts.mapInArrow(partial(_cut, width=width), _CUT), "pieces")
    drop(wanted)
    pieces = kept(cut.where(F.col("size") > CROWDED).mapInArrow(partial(_classes, width=width), _PIECE), "classes")
    known = kept(_firsts(pieces, ["bucket", "content"], place), "firsts")
    sizes = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    told = kept(pieces.join(known.join(sizes, "bucket", "left").drop("c"), ["bucket", "content"]).withColumn("leads", _is_first(place)).drop("first"), "classed")
    drop(pieces)
    done.append(kept(span(told.where("not leads"), width - 1), "gone"))
    classed = told.where("leads and size is not null").select("doc_id", "sub", "start", "n", "place", "bucket", "size", "bytes")
    small = cut.unionByName(classed).where(F.col("size") <= CROWDED).repartition("bucket").sortWithinPartitions("bucket")
    done.append(kept(small.mapInArrow(partial(_sorted_blocks, width=width), _GONE), "gone"))
    edges = kept(classed.where(F.col("size") > CROWDED).mapInArrow(partial(_edges, width=width), f"{_GONE}, bucket long, edge long"), "edges")
    done.append(edges.where("edge is null").select("doc_id", "sub", "lo", "hi"))
    last = edges.where("edge is not null")
    at = ["doc_id", "sub", "lo"]
    done.append(last.join(_firsts(last, ["bucket", "edge"], at).where("c > 1").drop("c"), ["bucket", "edge"]).where(~_is_first(at)).select("doc_id", "sub", "lo", "hi"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for every row of docs.

    `spans` are the maximal removed byte ranges, [lo, hi), in order; `kept` the bytes that
    remain.  Null texts are empty; texts shorter than `width` lose nothing; very long texts are
    taken whole.  A null doc_id sorts before all others.  Rows that share an id, or have none,
    are documents of their own, ordered by a hash of their texts; rows that repeat both id and
    text are one place: they cost each other nothing, and what is removed goes from all of
    them.  Equal strings are told by (doc_id, start), so there are no ties but those.  An empty
    table gives an empty one.  Other columns are ignored.
    """
    rows = _placed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    return _with_gone(rows, "text", width).select("doc_id", "text", F.col("__gone").alias("gone")).mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept binary")
