"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over consecutive words: the hash at a place takes the words that the
mask marks and ignores the others, so one changed word in an ignored place doesn't hide a
hit.  The seed hashes of benchmark items and of training texts are joined; around each hit
the text and the item are laid over each other without gaps, and the overlap counts if at
least `share` of the words of some window agree.

Everything about a text stays in its own row until a hit is verified: the words are split
once, the seed hashes are one array, and exploding, joining and verifying are one pipelined
stage.  Only verified overlaps are shuffled, once, to keep the best for each text and item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept, scratch

#: Masks over consecutive words: ones are hashed, zeros ignored.
MASKS = ("11111", "1101011")
#: More masks for items shorter than the window, of which fewer words may agree in a row.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
#: Words of the window that must agree, and the share of them that must.  With these, and items
#: of ITEM_WORDS and more, every overlap that the share allows has a seed (tests enumerate them).
WINDOW, SHARE_NUM, SHARE_DEN = 13, 80, 100
#: Items of fewer words overlap with nothing.
ITEM_WORDS = 5
#: Bytes of benchmark text up to which its seeds are broadcast (about 16 times as much in memory).
BROADCAST_BYTES = 4 << 20
#: Rows found that are broadcast at most (8 bytes each); beyond, the join is by shuffle.
BROADCAST_ROWS = 500_000


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, even if body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The lower-case words of a text: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds_of(words: Column, masks: tuple[str, ...]) -> Column:
    """The seed hashes at all places of a word array, one mask after another."""

    def of(mask: str, number: int):
        chosen = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(words) - len(mask)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.xxhash64(F.lit(number), *[words[p + i] for i in chosen]))

    return F.concat(*[of(m, i) for i, m in enumerate(masks)])


def place_of(at: Column, n: Column, masks: tuple[str, ...]) -> Column:
    """The place in a text of n words that entry `at` of its seeds stands for."""
    begin, out = F.lit(0), None
    for m in masks:
        count = F.greatest(n - (len(m) - 1), F.lit(0))
        here = (at >= begin) & (at < begin + count)
        out = F.when(here, at - begin) if out is None else out.when(here, at - begin)
        begin = begin + count
    return out


def seeded(rows: DataFrame, words: str, masks: tuple[str, ...], place: str) -> DataFrame:
    """A row for each seed of each row: all its columns, the seed, and its place."""
    rows = rows.withColumn("_seeds", _let(F.col(words), lambda w: seeds_of(w, masks)))
    keep = [c for c in rows.columns if c != "_seeds"]
    return rows.select(*keep, F.posexplode("_seeds").alias("_at", "seed")).select(*keep, "seed", place_of(F.col("_at"), F.size(words), masks).alias(place))


def overlap(words: Column, item: Column, shift: Column, window: Column, num: int, den: int) -> Column:
    """The best window of an item laid over a text at a shift: (matched, item_start), or null.

    Best is the most equal words, then the leftmost; null if the share isn't reached.
    """
    # out of range: null, which equals nothing
    equal = F.transform(F.sequence(F.lit(0), F.size(item) - 1), lambda j: F.coalesce((F.get(words, j + shift) == item[j]).cast("int"), F.lit(0)))
    # a window is short, so its sum costs the same wherever it begins
    total = lambda e, b: F.aggregate(F.slice(e, b + 1, window), F.lit(0), lambda acc, x: acc + x)
    scored = lambda e: F.transform(F.sequence(F.lit(0), F.size(item) - window), lambda b: F.struct(total(e, b).alias("matched"), (-b).alias("minus_start")))
    best = _let(equal, lambda e: F.array_max(scored(e)))
    return _let(best, lambda b: F.when(b["matched"] * den >= window * num, F.struct(b["matched"].alias("matched"), (-b["minus_start"]).alias("item_start"))))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS, window: int = WINDOW, share: tuple[int, int] = (SHARE_NUM, SHARE_DEN),
) -> DataFrame:
    """(doc_id, item_id, matched, window_words, doc_start, item_start) for each text and item that overlap.

    A text overlaps an item if, laid over it at some shift, at least share of the words of a
    window of `window` consecutive words of the item (the whole item, if it is shorter) are the
    same in both.  With the masks given, a seed agrees at every such shift.  The best window is
    reported: most equal words, then leftmost in the text, then in the item.  doc_start and
    item_start count words from 0.

    Items of fewer than ITEM_WORDS words, null and empty texts overlap with nothing; very long
    texts are taken whole.  Rows that repeat an id count as one text whose best window is
    reported; null ids are kept as one id.  An empty table on either side gives an empty one.
    Other columns are ignored.
    """
    num, den = share
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col).cast("string")).alias("item"))
    items = items.where(F.size("item") >= ITEM_WORDS).distinct()
    short = F.size("item") < window
    if short_masks and items.where(short).limit(1).count():  # texts are hashed under them only if some item needs it
        every = masks + short_masks
        item_seeds = seeded(items.where(short), "item", every, "q").unionByName(seeded(items.where(~short), "item", masks, "q"))
    else:
        every, item_seeds = masks, seeded(items, "item", masks, "q")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text_col).cast("string"))), F.lit(0))).first()[0]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    text_seeds = seeded(texts, "words", every, "p")
    if size <= BROADCAST_BYTES:
        hits = text_seeds.join(F.broadcast(item_seeds), "seed")
    else:
        # too large to send everywhere: first find which texts and shifts are hit, by a shuffle on
        # the seed alone, then bring words and items to the few hits
        found = text_seeds.select("doc_id", "seed", "p").join(item_seeds.select("seed", "item_id", "q"), "seed")
        found = kept(found.groupBy("doc_id", "item_id", (F.col("p") - F.col("q")).alias("shift")).agg(F.min("p").alias("p"), F.min("q").alias("q")), "hits")
        t, i = texts.select(F.col("doc_id").alias("d"), "words"), items.select(F.col("item_id").alias("i"), "item")
        hits = found.drop("shift").join(t, found["doc_id"].eqNullSafe(t["d"])).join(i, found["item_id"].eqNullSafe(i["i"]))
    # neighbouring hits at one shift verify the same overlap: only the first of each row of them is needed
    p, q = F.col("p"), F.col("q")
    same = [F.coalesce(F.get("words", p - 1 + k) == F.get("item", q - 1 + k), F.lit(False)) for k, c in enumerate(masks[0]) if c == "1"]
    new = (p == 0) | (q == 0) | ~reduce(lambda a, b: a & b, same)
    # cut the stretch of words under the item out of the text before anything leaves the stage;
    # exploding an array of one keeps the cut from being moved further up
    shift, n = p - q, F.size("item")
    head = F.greatest(-shift, F.lit(0))  # words of the item before the text begins
    piece = F.slice("words", F.greatest(shift, F.lit(0)) + 1, F.greatest(n - head, F.lit(0)))
    cut = hits.where(new).select("doc_id", "item_id", "item", shift.alias("shift"), head.alias("head"), F.explode(F.array(piece)).alias("piece"))
    w = F.least(F.lit(window), F.size("item"))
    best = cut.select("doc_id", "item_id", "shift", w.alias("window_words"), overlap(F.col("piece"), F.col("item"), -F.col("head"), w, num, den).alias("o")).where("o is not null")
    ranked = best.select("doc_id", "item_id", F.struct((-F.col("o.matched")).alias("m"), (F.col("shift") + F.col("o.item_start")).alias("d"), F.col("o.item_start").alias("i"), F.col("window_words").alias("w")).alias("r")).groupBy("doc_id", "item_id").agg(F.min("r").alias("r"))
    return ranked.select("doc_id", "item_id", (-F.col("r.m")).cast("int").alias("matched"), F.col("r.w").alias("window_words"), F.col("r.d").alias("doc_start"), F.col("r.i").alias("item_start"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that overlap no benchmark item.

    Rows are judged by id and text, so a null id or one that several texts share saves or costs
    no other row.  Null and empty texts stay; an empty table on either side changes nothing.
    """
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    with scratch(docs.sparkSession):
        hits = overlaps(docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text")), benchmark, id_col="row", text_col="text")
        found = kept(hits.select(F.col("doc_id").alias("__row")).distinct(), "contaminated", lasting=True)
    few = found.count() <= BROADCAST_ROWS
    return docs.withColumn("__row", row).join(F.broadcast(found) if few else found, "__row", "left_anti").select(*docs.columns)
