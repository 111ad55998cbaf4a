"""Near duplicates: set similarity of bodies through an inverted index that leaves out common shapes.

Signatures are long: norm_hash, subtree_hash, nodes, parent_hash (null at the root).  A shape
in more than `COMMON` bodies makes no candidates, so no posting list makes more pairs than
COMMON squared; it still counts in the sizes of the sets.  Where common shapes count as shared
(`common` None, neighbours), `postings.overlaps` has them too, without lists of all their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import postings

THRESHOLD, COMMON = 0.70, 64
#: The threshold as single precision holds it, which is what a similarity is compared with.
THRESHOLD_F32 = 0.699999988079071


def keyed(sets: DataFrame, hexed: bool, wanted: Column | None = None) -> DataFrame:
    """(key, n, wanted, shapes) of sets (norm_hash, shapes), for `postings`; a hash of 16 hex digits is its own key."""
    key = F.conv("norm_hash", 16, -10).cast("long") if hexed else F.xxhash64("norm_hash")
    n = F.size("shapes")
    return sets.where(n > 0).select(key.alias("key"), n.alias("n"), (F.lit(False) if wanted is None else wanted).alias("wanted"), "shapes")


def named(found: DataFrame, sets: DataFrame, hexed: bool) -> DataFrame:
    """found with the norm_hash of a and b in place of their keys."""
    for side in ("a", "b"):
        if hexed:
            found = found.withColumn(side, F.lower(F.lpad(F.hex(side), 16, "0")))
        else:
            names = sets.select(F.xxhash64("norm_hash").alias(side), F.col("norm_hash").alias("_name")).distinct()
            found = found.join(names, side).drop(side).withColumnRenamed("_name", side)
    return found


def pairs_of_sets(sets: DataFrame, rows: int, threshold: float = THRESHOLD_F32, common: int | None = COMMON, hexed: bool = False) -> DataFrame:
    """The pairs of sets (norm_hash, shapes), copies repeated or not, that have about `rows` shapes in all.

    Shapes in more than `common` bodies don't count as shared; with None all do.
    """
    k = keyed(sets, hexed)
    found = postings.overlaps(k, rows, threshold, COMMON) if common is None else postings.counted(postings.lists(k, rows, common))
    jaccard = F.col("shared") / F.greatest(F.col("n_a") + F.col("n_b") - F.col("shared"), F.lit(1))
    found = named(found.withColumn("similarity", jaccard).where(F.col("similarity") >= threshold), sets, hexed)
    turn = F.col("a") > F.col("b")
    size = lambda one, other: F.when(turn, F.col(other)).otherwise(F.col(one)).cast("long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", size("n_a", "n_b").alias("shapes_a"), size("n_b", "n_a").alias("shapes_b"), "similarity")


def pairs(signatures: DataFrame, bodies: DataFrame | None = None, threshold: float = THRESHOLD_F32, common: int | None = COMMON) -> DataFrame:
    """(a, b, shared, shapes_a, shapes_b, similarity) with a < b and similarity >= threshold, of some bodies or all."""
    signatures = of_bodies(signatures, bodies)
    return pairs_of_sets(whole_sets(signatures), signatures.count(), threshold, common)


def of_bodies(signatures: DataFrame, bodies: DataFrame | None) -> DataFrame:
    return signatures if bodies is None else signatures.join(bodies.select("norm_hash").distinct(), "norm_hash", "left_semi")


def covered(signatures: DataFrame, found: DataFrame) -> DataFrame:
    """found (a, b, ...) with shared_nodes, differing_nodes and node_ratio.

    The nodes of the shared shapes that have no shared parent, summed on each side; the least
    of both and of the bodies' own nodes.  Here shapes count however common they are.
    """
    sig = signatures.dropDuplicates(["norm_hash", "subtree_hash"])
    on = lambda side: sig.select(F.col("norm_hash").alias(side), "subtree_hash", F.col("nodes").alias(f"n_{side}"), F.col("parent_hash").alias(f"p_{side}"))
    both = found.select("a", "b").join(on("a"), "a").join(on("b"), ["b", "subtree_hash"])
    out = found
    for side in ("a", "b"):
        known = both.select("a", "b", F.col("subtree_hash").alias(f"p_{side}"))
        top = both.join(known, ["a", "b", f"p_{side}"], "left_anti")
        out = out.join(top.groupBy("a", "b").agg(F.sum(f"n_{side}").alias(f"cover_{side}")), ["a", "b"], "left")
        root = sig.where(F.col("parent_hash").isNull()).groupBy(F.col("norm_hash").alias(side)).agg(F.max("nodes").alias(f"nodes_{side}"))
        out = out.join(root, side, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shared = F.least(zero("cover_a"), zero("cover_b"), zero("nodes_a"), zero("nodes_b"))
    out = out.withColumn("shared_nodes", shared).withColumn("differing_nodes", zero("nodes_a") + zero("nodes_b") - 2 * F.col("shared_nodes"))
    total = F.col("shared_nodes") + F.col("differing_nodes")
    return out.withColumn("node_ratio", F.when(total > 0, F.col("shared_nodes") / total).otherwise(0.0)).drop("cover_a", "cover_b", "nodes_a", "nodes_b")


def stats(signatures: DataFrame, bodies: DataFrame, common: int = COMMON) -> DataFrame:
    """One row on the work: bodies, shapes, dropped_common, candidates, exhaustive."""
    signatures = of_bodies(signatures, bodies)
    return stats_of_sets(whole_sets(signatures), signatures.count(), bodies, common)


def stats_of_sets(sets: DataFrame, rows: int, bodies: DataFrame, common: int = COMMON, hexed: bool = False) -> DataFrame:
    """`stats` of sets (norm_hash, shapes); the lists are made once, and pairs and numbers come from the same pass."""
    n = bodies.select("norm_hash").distinct().agg(F.count(F.lit(1)).alias("bodies"))
    found = postings.lists(keyed(sets, hexed), rows, common, count=True).groupBy("kind", "a", "b").agg(F.lit(0))
    of_bin = lambda c: F.coalesce(F.sum(F.when(F.col("kind") < 0, F.col(c))), F.lit(0))
    m = found.agg(of_bin("a").alias("shapes"), of_bin("b").alias("dropped_common"), F.count_if(F.col("kind") == postings.PAIR).alias("candidates"))
    return n.crossJoin(m).withColumn("exhaustive", F.floor(F.col("bodies") * (F.col("bodies") - 1) / 2).cast("long"))


def representatives(units: DataFrame) -> DataFrame:
    """The first unit of each body, by path and line."""
    rest = [c for c in units.columns if c not in ("norm_hash", "path", "line")]
    return units.groupBy("norm_hash").agg(F.min(F.struct("path", "line", *rest)).alias("u")).select("norm_hash", "u.*")


def neighbors(signatures: DataFrame, target: DataFrame, bodies: DataFrame | None = None, threshold: float = THRESHOLD_F32) -> DataFrame:
    """(target, norm_hash, shared, similarity) of bodies near the target bodies; common shapes count here."""
    wanted = None if bodies is None else bodies.select("norm_hash").union(target.select("norm_hash"))
    signatures = of_bodies(signatures, wanted)
    marked = whole_sets(signatures).join(target.select("norm_hash").distinct().withColumn("_t", F.lit(True)), "norm_hash", "left")
    return neighbors_of_sets(marked.withColumn("wanted", F.coalesce("_t", F.lit(False))), signatures.count(), threshold)


def neighbors_of_sets(sets: DataFrame, rows: int, threshold: float = THRESHOLD_F32, hexed: bool = False) -> DataFrame:
    """`neighbors` of sets (norm_hash, wanted, shapes); a body is a target if one of its rows is wanted."""
    found = named(postings.overlaps(keyed(sets, hexed, F.col("wanted")), rows, threshold, COMMON, wanted=True), sets, hexed)
    j = F.col("shared") / F.greatest(F.col("n_a") + F.col("n_b") - F.col("shared"), F.lit(1))
    return found.select(F.col("a").alias("target"), F.col("b").alias("norm_hash"), "shared", j.alias("similarity"))


def whole_sets(signatures: DataFrame) -> DataFrame:
    """(norm_hash, shapes): each body with the array of its distinct shapes, as many as its nodes at most."""
    return signatures.groupBy("norm_hash").agg(F.collect_set("subtree_hash").alias("shapes"))


def neighbors_of(bodies: DataFrame, body: str, threshold: float = THRESHOLD_F32) -> DataFrame:
    """(norm_hash, shared, similarity) of bodies (norm_hash, shapes) near one of them: one pass, and only results are shuffled."""
    own = bodies.where(F.col("norm_hash") == body).select("shapes").limit(1).collect()
    mine = F.array(*[F.lit(h) for h in own[0]["shapes"]]) if own and own[0]["shapes"] else F.array().cast("array<long>")
    met = bodies.where(F.col("norm_hash") != body).select("norm_hash", F.size("shapes").alias("n"), F.size(F.array_intersect("shapes", mine)).cast("long").alias("shared"))
    j = F.col("shared") / F.greatest(F.col("n") + F.size(mine) - F.col("shared"), F.lit(1))
    return met.withColumn("similarity", j).where((F.col("shared") > 0) & (F.col("similarity") >= threshold)).select("norm_hash", "shared", "similarity").distinct()


def uncovered(units: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row (uncovered_lang, uncovered_small): bodies without any shape to compare.

    units: norm_hash, path, line, lang.  The first counts bodies of languages that have no shapes
    at all (Rust), the second those that are too small to hold one; the first unit of a body says.
    """
    bodies = units.where(F.col("norm_hash").isNotNull()).groupBy("norm_hash").agg(F.min(F.struct("path", "line", "lang")).alias("u"))
    bare = bodies.join(signatures.select("norm_hash").distinct(), "norm_hash", "left_anti")
    flat = F.col("u.lang") == "rust"
    return bare.agg(F.count_if(flat).alias("uncovered_lang"), F.count_if(~flat).alias("uncovered_small"))


def ordered(found: DataFrame) -> DataFrame:
    """Neighbours (similarity, path, line, ...) in report order: the nearest first, then by place."""
    return found.orderBy(F.desc("similarity"), "path", "line")
