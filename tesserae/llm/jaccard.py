"""N-gram Jaccard join: exact similarity links between documents and their components.

Method.  Every text becomes the sorted set of its word-shingle hashes.  Identical sets are
one class.  For two sets of sizes s <= t with Jaccard >= num/den the sizes differ by at most
den/num, and their symmetric difference by at most (s+t)(den-num)/(den+num).  Sizes are cut
into bands of that ratio, so a pair lies in one band or two neighbouring ones; a *tile* is a
band with the next one.  Within a tile the hash space is cut into more segments than the
largest possible difference, so linked sets agree wholly on at least one segment: the
tile's segments with equal content are the only places where links can be.  Segments hold
many shingles, so frequent words or lines don't make them crowded.

Within a tile, hashed bitmap signatures bound the overlap from above: each differing element
flips at most one bit, so the popcount of the exclusive or is at most the symmetric
difference.  Pairs that pass are settled by intersecting the sorted arrays exactly.

Classes already joined through other links are not compared again: first every set is
compared with hubs of its segments, some times over, then only pairs across the components
so found, each pair in the one of their common segments whose key is least.
Large segments are cut into blocks, and blocks are compared two by two in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BASE_A, BASE_B, U64, flat, lists, mix, release, shingles, signed, steps
from .storage import drop, kept, scratch

#: Rows of a segment compared in one task; larger ones are cut into blocks of this many.
BLOCK = 1024
#: Rows of an open segment up to which a pair may be compared in several of them.
SMALL = 8
#: Times that sets are compared with hubs before what is left is compared in pairs, and with how many each.
TURNS, HUBS = 2, 4
#: Ids that are broadcast at most (8 bytes each); beyond, the join is by shuffle.
BROADCAST_IDS = 500_000
#: Bits of a bitmap at most, so that a block of them stays small.
WIDEST = 1 << 16
#: Classes with more than one HOTth of all rows are fewer than HOT, and are sent to every task.
HOT = 5_000
#: Shingles of a set at most: a text has fewer than 1 << 31 bytes.
LARGEST = 1 << 31


class Bands:
    """Size bands for a Jaccard threshold num/den, and how each tile is segmented."""

    def __init__(self, num: int, den: int, largest: int) -> None:
        lo, self.lo = 1, []
        while True:
            self.lo.append(lo)
            if lo > largest:
                break
            lo = lo * den // num + 1
        self.lo.append(self.lo[-1] * den // num + 1)
        n = len(self.lo) - 2
        segments, spare = [0] * n, [0] * n
        for b in range(n):
            top = self.lo[b + 1] - 1 + (self.lo[b + 2] - 1)
            h = top * (den - num) // (den + num)
            if h:
                z = 1
                for _ in range(50):  # as many spare segments as sets of this size leave empty, with a margin
                    g = h + 1 + z
                    empty = g * (1 - 1 / g) ** self.lo[b]
                    if z >= empty + 4 * empty**0.5:
                        break
                    z += 1
                segments[b], spare[b] = h + 1 + z, z
        self.segments, self.spare = np.array(segments, np.int64), np.array(spare, np.int64)
        self.starts = np.array(self.lo[:n], np.int64)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums, wrapping around, of the values of each text; 0 for none."""
    out = np.zeros(len(counts), U64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def segment_keys(h: np.ndarray, owner: np.ndarray, counts: np.ndarray, bands: Bands, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the agreeing-segment test, and the text of each, for the tile `down` bands below."""
    tile = bands.band(np.maximum(counts, 1)) - down
    use = (tile >= 0) & (counts > 0)
    g = np.where(use, bands.segments[np.maximum(tile, 0)], 0)
    per = g[owner]
    at = np.flatnonzero(per > 0)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    hs, own, per = h[at], owner[at], per[at].astype(U64)
    seg = ((hs >> U64(32)) * per) >> U64(32)  # grows with the hash, so each segment is a run
    begin = np.ones(len(at), bool)
    begin[1:] = (seg[1:] != seg[:-1]) | (own[1:] != own[:-1])
    run = np.flatnonzero(begin)
    content = np.add.reduceat(mix(hs + U64(BASE_B)), run)
    of, seg = own[run], seg[run]
    key = mix(content ^ mix((tile[of].astype(U64) << U64(32)) | seg))
    full = np.bincount(of, minlength=len(counts))
    odd = np.flatnonzero(use & (g > 0) & (g - full > bands.spare[np.maximum(tile, 0)]))  # more empty segments than are spare
    return np.concatenate((key, mix(tile[odd].astype(U64) + U64(BASE_A)))), np.concatenate((of, odd))


def _names(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's identity."""
    n = counts.astype(U64)
    return mix(_per_text(mix(h ^ U64(BASE_A)), counts) + n), mix(_per_text(mix(h ^ U64(BASE_B)), counts) ^ n)


def _features(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    bands = Bands(num, den, LARGEST)
    for batch in steps(batches, "text"):
        buf, off = flat(batch.column("text"))
        h, owner, counts = shingles(buf, off, size)
        s1, s2 = _names(h, counts)
        _, first = np.unique(s1, return_index=True)  # equal sets of this step give their keys once
        lead = np.zeros(len(counts), bool)
        lead[first] = True
        keep = lead[owner]
        hh, oo = h[keep], owner[keep]
        cc = np.where(lead, counts, 0)
        pairs = [segment_keys(hh, oo, cc, bands, down) for down in (0, 1)]
        key, of = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((of, key))
        key, of = key[order], of[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        again = ~head
        many = again.copy()
        many[:-1] |= again[1:]
        cols = [batch.column("doc_id"), batch.column("row"), pa.array(counts), signed(s1), signed(s2)]
        for chosen in (head, many):
            k, o = key[chosen], of[chosen]
            turn = np.argsort(o, kind="stable")
            cols.append(lists(signed(k[turn]), np.bincount(o, minlength=len(counts))))
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_shingles", "s1", "s2", "once", "many"])


def features(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, row, n_shingles, s1, s2, once, many) for each row of docs (doc_id, row, text).

    s1 and s2 identify the set.  `once` holds the segment keys that were met first with this
    row in its step, `many` all keys that the step met more than once.
    """
    return docs.mapInArrow(partial(_features, size=size, num=num, den=den), "doc_id long, row long, n_shingles long, s1 long, s2 long, once array<long>, many array<long>")


def _bits(h: np.ndarray, width: int) -> np.ndarray:
    """A set's bitmap of `width` bits, a power of two: each element flips the bit it hashes to."""
    at = (mix(h + U64(BASE_A)) & U64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8))


def width_of(n: int) -> int:
    """Bits of a bitmap: by powers of four, so neighbouring bands mostly share one width; WIDEST bound weaker."""
    w = 256
    while w < 2 * n and w < WIDEST:
        w *= 4
    return w


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        buf, off = flat(batch.column("text"))
        h, _, counts = shingles(buf, off, size)
        at = np.concatenate(([0], np.cumsum(counts)))
        # rows whose ids and texts hash alike: only the text whose set is meant
        s1, s2 = (x.view(np.int64) for x in _names(h, counts))
        mine = np.flatnonzero((s1 == batch.column("s1").to_numpy()) & (s2 == batch.column("s2").to_numpy()))
        sets = [h[at[i] : at[i + 1]] for i in mine]
        of = pa.array(mine)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").take(of), batch.column("times").take(of), pa.array(counts[mine]), pa.array([_bits(x, width_of(len(x))).tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
            names=["node", "times", "n", "bits", "items"],
        )


def fold(bits: np.ndarray, to: int) -> np.ndarray:
    """A bitmap narrowed to `to` bytes: the same as if it had been made that narrow."""
    return np.bitwise_xor.reduce(bits.reshape(-1, to), axis=0) if len(bits) > to else bits


def may_link(na: int, nb: int, xor_bits: int, num: int, den: int) -> bool:
    """Whether the overlap's upper bound (na + nb - differing bits) / 2 reaches the threshold."""
    most = (na + nb - xor_bits) // 2
    return den * most >= num * (na + nb - most)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _pass(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs that their bitmaps let pass."""
    for batch in batches:
        bits = [batch.column(c) for c in ("bits_a", "bits_b")]
        na, nb = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        yes = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            xa, xb = (np.frombuffer(c[i].as_buffer(), np.uint8) for c in bits)
            to = min(len(xa), len(xb))
            yes[i] = may_link(int(na[i]), int(nb[i]), int(np.bitwise_count(fold(xa, to) ^ fold(xb, to)).sum()), num, den)
        at = pa.array(yes)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(at), batch.column("b").filter(at)], names=["a", "b"])
    release()


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs that link, by their sorted items."""
    for batch in batches:
        items = [batch.column(c) for c in ("items_a", "items_b")]
        at = pa.array([linked(*(np.frombuffer(c[i].as_buffer(), U64) for c in items), num, den) for i in range(batch.num_rows)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(at), batch.column("b").filter(at)], names=["a", "b"])
    release()


def _with_sets(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pairs (a, b) of nodes with these columns of both sets."""
    side = lambda x: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _passing(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that bitmaps let pass; only bitmaps are sent."""
    return _with_sets(pairs, sets, ("n", "bits")).mapInArrow(partial(_pass, num=num, den=den), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    return _with_sets(pairs, sets, ("items",)).mapInArrow(partial(_verify, num=num, den=den), "a long, b long")


def _met(keys: pa.ListArray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the keys below `below`: where each row's begin, their groups, and each group's begin and rows."""
    flat_keys = keys.flatten().to_numpy()
    row = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
    less = flat_keys < below
    row, (_, group) = row[less], np.unique(flat_keys[less], return_inverse=True)
    order = np.argsort(group, kind="stable")
    begins = np.concatenate(([0], np.cumsum(np.bincount(group)))) if len(group) else np.zeros(1, np.int64)
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(keys))))), group, begins, row[order]


def _tile(table: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs of one block pair, across components, that their bitmaps let pass.

    A pair that also shares an open segment of a smaller key is left to that one; in segments of
    few rows nobody asks.
    """
    node, comp, n, half = (table.column(c).to_numpy() for c in ("node", "comp", "n", "half"))
    bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")]
    to = min((len(x) for x in bits), default=0)
    m = np.stack([fold(x, to) for x in bits]) if bits else np.zeros((0, 1), np.uint8)
    of, group, begins, rows = _met(table.column("keys").combine_chunks(), table.column("key")[0].as_py())
    out_a, out_b = [], []
    for i in range(len(node)):
        fresh = (comp != comp[i]) & ((half != half[i]) | (half[i] == 2))
        fresh[: i + 1] = False
        for g in group[of[i] : of[i + 1]]:
            fresh[rows[begins[g] : begins[g + 1]]] = False
        later = np.flatnonzero(fresh)
        if not len(later):
            continue
        diff = np.bitwise_count(m[later] ^ m[i]).sum(axis=1, dtype=np.int64)
        most = (n[later] + n[i] - diff) // 2
        good = later[den * most >= num * (n[later] + n[i] - most)]
        out_a += [np.minimum(node[good], node[i])]
        out_b += [np.maximum(node[good], node[i])]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"a": cat(out_a), "b": cat(out_b)})


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b). Nodes without edges are absent.

    Alternating large-star and small-star steps, each written to the shared folder; the
    number of rounds grows with the logarithm of the longest chain.
    """
    e = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        after = kept(small, "edges")
        total = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h"))
        same = e.agg(total.alias("x")).first() == after.agg(total.alias("x")).first()
        drop(e)
        e = after
        if same:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _segments(feats: DataFrame) -> DataFrame:
    """(key, s1) of the segments that more than one set has."""
    first = feats.select(F.explode("once").alias("key"), "s1")
    crowd = first.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("c > 1").select("key", "s1")
    return crowd.unionByName(feats.select(F.explode("many").alias("key"), "s1")).distinct()


def _load(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, bits, items): the sets of the wanted classes, one row each."""
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "row").select("node", "s1", "s2", "times", "text")
    sets = kept(texts.mapInArrow(partial(_sets, size=size), "node long, times long, n long, bits binary, items binary"), "sets")
    if wanted.where("times > 1").limit(1).count():  # repeated rows give their set each: only these are shuffled
        again = kept(sets.where("times = 1").unionByName(sets.where("times > 1").dropDuplicates(["node"])), "sets")
        drop(sets)
        sets = again
    return sets.drop("times")


def _open_segments(placed: DataFrame) -> DataFrame:
    """(key, node, comp, rows) of segments whose members aren't in one component yet.

    Texts that are alike but not linked share many segments; of segments with the same
    members, told by two hash sums, one stays.
    """
    told = placed.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")
    )
    split = told.where("lo != hi").groupBy("rows", "h1", "h2").agg(F.min("key").alias("key")).select("key", "rows")
    return placed.drop("rows").join(split, "key")


def _star(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node with the HUBS hubs that it shares most segments with, of those of other components.

    A segment's hub is one of its members, drawn by a hash that differs from turn to turn.
    """
    drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "comp")
    hubs = placed.groupBy("key").agg(F.min(drawn).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key", "hub")
    met = placed.join(hubs, "key").where("comp != hub.comp").groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("shared"))
    ranked = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("shared", "hub")), asc=False).alias("hubs"))
    best = ranked.select("node", F.explode(F.slice("hubs", 1, HUBS)).alias("best"))
    return best.select(F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b")).distinct()


def _linked_classes(docs: DataFrame, feats: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame] | None:
    """The classes that may link, (node, s1, s2, n_shingles, low), and their components (node, comp)."""
    active = kept(_segments(feats), "segments")
    drop(feats)
    names = active.select("s1").distinct()
    # the number of a class is drawn once and written
    wanted = kept(classes.join(names, "s1", "left_semi").select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n_shingles", "low", F.col("first.row").alias("row"), "times"), "wanted")
    if not wanted.limit(1).count():
        return None
    sets = _load(docs, wanted, size)
    placed = kept(active.join(wanted.select("s1", "node"), "s1").select("key", "node", F.col("node").alias("comp")), "placed")
    drop(active)
    edges = None
    for turn in range(TURNS):
        star = kept(_star(placed, turn), "star")
        likely = kept(_passing(star, sets, num, den), "likely")
        more = kept(_verified(likely, sets, num, den), "links")
        edges = more if edges is None else edges.unionByName(more)
        comp = kept(components(edges), "components")
        now = placed.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_ = kept(_open_segments(now), "placed")
        drop(placed)
        placed = open_
        if not open_.limit(1).count():
            return wanted, comp
    keys = placed.groupBy("node").agg(F.collect_list("key").alias("keys"))  # as many as a text has segments, at most
    told = kept(sets.select("node", "n", "bits").join(keys, "node"), "told")
    dealt = placed.withColumn("nb", F.ceil(F.col("rows") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    spread = dealt.select("*", other.alias("with")).select(
        "key", "node", "comp", "rows", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), F.when(F.col("mine") == F.col("with"), 2).when(F.col("mine") < F.col("with"), 0).otherwise(1).alias("half")
    )

    def compare(table: pa.Table) -> pa.Table:
        return _tile(table, num, den)

    less = F.filter("keys", lambda k: k < F.col("key"))
    tiles = spread.join(told, "node").withColumn("keys", F.when(F.col("rows") > SMALL, less).otherwise(F.array().cast("array<long>")))
    pairs = kept(tiles.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "likely")
    more = kept(_verified(pairs, sets, num, den), "links")
    return wanted, kept(components(edges.unionByName(more)), "components")


def _classes(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, n_shingles, s1, s2), and what is to be known of their classes.

    The second table has a row for each class of equal sets that has more than one row or is
    linked: (s1, s2, n_shingles, copies, component_id, keeper), the keeper being the row of
    least id in the component, null ids last.
    """
    feats = kept(features(docs, size, num, den), "shingles")
    rows = kept(feats.select("doc_id", "row", "n_shingles", "s1", "s2"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # how many rows are the first one: equal ids and texts
    by_row = rows.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles", "doc_id", "row").agg(F.count(F.lit(1)).alias("times"))
    classes = kept(
        by_row.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("low"), F.sum("times").alias("copies"), F.min(order).alias("first"), F.min_by("times", order).alias("times")), "classes"
    )
    found = _linked_classes(docs, feats, classes, size, num, den)
    names = ["s1", "s2", "n_shingles"]
    if found is None:
        known = classes.where("copies > 1").select(*names, "copies", F.col("low").alias("component_id"), F.col("first.row").alias("keeper"))
        return rows, kept(known, "known")
    wanted, comp = found
    placed = comp.join(wanted, "node").join(classes.select(*names, "first", "copies"), names)
    heads = placed.groupBy("comp").agg(F.min("low").alias("component_id"), F.min("first").alias("head"))
    joined = placed.join(heads, "comp").select(*names, "copies", "component_id", F.col("head.row").alias("keeper"))
    alone = classes.where("copies > 1").join(joined.select(*names), names, "left_anti").select(*names, "copies", F.col("low").alias("component_id"), F.col("first.row").alias("keeper"))
    return rows, kept(joined.unionByName(alone), "known")


def _told(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with component_id and keeper, null where the class is of one row and has no links."""
    names = ["s1", "s2", "n_shingles"]
    total = rows.count()
    few = F.broadcast(known.where(F.col("copies") * HOT > total).drop("copies"))
    rest = known.where(F.col("copies") * HOT <= total).drop("copies")
    return rows.join(few, names).unionByName(rows.join(few.select(*names), names, "left_anti").join(rest, names, "left"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("row"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Documents link when den * |A and B| >= num * |A or B| for threshold = (num, den), over
    sets of distinct `size`-word shingles; words are runs of bytes other than space and
    0x09-0x0D, with A-Z lower-cased.  component_id is the smallest doc_id reachable.

    Null or empty texts, and texts of white space, have no shingles and link with nothing.
    A text of fewer than `size` words has its whole sequence as its one shingle; a very long
    text is one set like any other.  Repeated rows each give a row.  Rows are compared as
    rows, whatever their ids: texts under one id, or under null, link only if they are alike.
    A component's id is null if all of its ids are, and a null id otherwise never lends itself
    to one.  An empty table gives an empty one.  Other columns are ignored.
    """
    num, den = threshold
    with scratch(docs.sparkSession):
        told = _told(*_classes(_rows(docs, id_col, text_col), size, num, den))
        return kept(told.select("doc_id", "n_shingles", F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "components", lasting=True)


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs, with all their columns, one for each component of `jaccard_components`.

    The row of smallest id stays, a null id last; of rows with the same id the one whose hash
    with its text is least, and of rows that repeat both id and text one.  Texts without words are
    alike to nothing and stay.
    """
    num, den = threshold
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    with scratch(docs.sparkSession):
        told = _told(*_classes(_rows(docs, id_col, text_col), size, num, den))
        out = told.where("keeper is not null").groupBy("row").agg(F.min("keeper").alias("keeper"), F.count(F.lit(1)).alias("times"))
        marked = kept(out.where("row != keeper or times > 1").select(F.col("row").alias("__row"), (F.col("row") == F.col("keeper")).alias("__stays")), "marked", lasting=True)
        n = marked.groupBy("__stays").count().collect()
    sent = F.broadcast(marked) if sum(r["count"] for r in n) <= BROADCAST_IDS else marked
    of = docs.withColumn("__row", row)
    out = of.join(sent, "__row", "left_anti")
    if any(r["__stays"] for r in n):  # rows that are there several times: one of each
        out = out.unionByName(of.join(marked.where("__stays").select("__row"), "__row").dropDuplicates(["__row"]))
    return out.select(*docs.columns)
