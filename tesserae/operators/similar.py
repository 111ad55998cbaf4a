"""Finding a unit by name or place, and its neighbours in three tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import Policy
from ..functions.text import common_prefix, name_in
from ..functions.vectors import cosine
from . import near

TIERS = ("structural", "near", "semantic")
SUGGESTIONS = 3


def resolve(units: DataFrame, target: str) -> DataFrame:
    """One row (status, matches, path, line): 'found', 'ambiguous' or 'missing'; path and line of the first match.

    A target is path:line, or an id.  `matches` counts places.
    """
    path, _, line = target.rpartition(":")
    hit = units.where((F.col("path") == path) & (F.col("line") == int(line))) if path and line.isdigit() else units.where(F.col("id") == target)
    one = hit.agg(F.countDistinct("path", "line").alias("matches"), F.min(F.struct("path", "line")).alias("f"))
    return one.select(F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "found").otherwise("ambiguous").alias("status"), "matches", "f.path", "f.line")


def suggestions(units: DataFrame, target: str, n: int = SUGGESTIONS) -> DataFrame:
    """(id, shared): ids that begin like a mistyped one, sharing three quarters of it at least."""
    p = common_prefix(F.lower("id"), F.lit(target.lower()))
    q = common_prefix(F.lower(name_in(F.col("id"))), F.lit(target.lower()))
    return units.select("id").distinct().withColumn("shared", F.greatest(p, q)).where(F.col("shared") * 4 >= 3 * len(target)).orderBy(F.desc("shared"), "id").limit(n)


def similar(
    units: DataFrame, signatures: DataFrame | None, target: DataFrame, policy: Policy | None = None, *, floor: float = 0.0, limit: int = 10, threshold: float = near.THRESHOLD_F32, bodies: DataFrame | None = None
) -> DataFrame:
    """(tier, path, line, unit, similarity, rank) for one target unit (a one-row frame of units).

    First bodies that hash alike at another place, then bodies whose shapes are near, then
    vectors; a unit is in the first tier that claims it.  The target's row is read first, so
    every tier compares with plain values and units are read once.  Shapes come as signatures or,
    where they are at hand as sets, as bodies (norm_hash, shapes).
    """
    policy = policy or Policy()
    cols = ("tier", "path", "line", "unit", "similarity", "rank")
    found = target.select("path", "line", "norm_hash", "vec").limit(1).collect()
    if not found:
        kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
        return units.sparkSession.createDataFrame([], f"tier string, path string, line {kinds['line']}, unit {kinds['unit']}, similarity double, rank int")
    (t,) = found
    shown = units.where(policy.reported(policy.of(F.col("path"))))
    others = shown.where((F.col("path") != t["path"]) | (F.col("line") != t["line"]))
    similarity = F.lit(0.0)
    tier = F.lit(None).cast("int")
    if t["vec"] is not None:
        close = cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in t["vec"]]))
        similarity = F.when(F.col("vec").isNotNull(), close)
        tier = F.when(F.col("vec").isNotNull() & (close >= floor), 2)
    if t["norm_hash"] is not None:
        near_ = near.neighbors_of(near.whole_sets(signatures) if bodies is None else bodies, t["norm_hash"], threshold).select("norm_hash", F.col("similarity").alias("_near"))
        others = others.join(near_, "norm_hash", "left")
        same = F.coalesce(F.col("norm_hash") == t["norm_hash"], F.lit(False))
        similarity = F.when(same, 1.0).when(F.col("_near").isNotNull(), F.col("_near")).otherwise(similarity)
        tier = F.when(same, 0).when(F.col("_near").isNotNull(), 1).otherwise(tier)
    placed = others.select("unit", "path", "line", tier.alias("tier_no"), similarity.alias("similarity")).where("tier_no is not null")
    top = placed.orderBy("tier_no", F.desc("similarity"), "path", "line").limit(limit)
    order = Window.partitionBy(F.lit(0)).orderBy("tier_no", F.desc("similarity"), "path", "line")
    name = F.element_at(F.array(*[F.lit(x) for x in TIERS]), F.col("tier_no") + 1)
    return top.withColumn("rank", F.row_number().over(order)).withColumn("tier", name).select(*cols)
