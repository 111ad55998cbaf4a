"""Exact duplicates: units whose normalised bodies hash alike, ranked by what merging would save.

Groups and members are two relations: a group is aggregates only, so a body with any number
of copies costs no task more memory than a body with two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import Policy, under

MIN_LINES = 4


def candidates(units: DataFrame, scope: str | None = None, min_lines: int = MIN_LINES) -> DataFrame:
    """Units in scope with a body of at least `min_lines` lines, one for each (path, line).

    Units: path, line, end_line, lang, owner, id, norm_hash (16 hex digits or null), nodes.
    """
    rows = units.where(under(F.col("path"), scope) & F.col("norm_hash").isNotNull() & (F.col("end_line") + 1 - F.col("line") >= min_lines))
    first = F.row_number().over(Window.partitionBy("path", "line").orderBy("norm_hash", "id"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r")


def groups(units: DataFrame, policy: Policy | None = None, *, scope: str | None = None, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """(groups, withheld) of exact duplicates.

    groups: norm_hash, lang, copies, lines, nodes, saves_nodes, population, path, line (of the
    first member).  A group all of whose members are in classes that aren't reported is
    withheld, under the class of its first member.  population is the members' class, or
    'mixed'.  Missing node counts save nothing.
    """
    policy = policy or Policy()
    rows = candidates(units, scope, min_lines).withColumn("class", policy.of_unit(F.col("path"), F.col("lang"), F.col("owner")))
    rows = rows.withColumn("shown", policy.reported(policy.of(F.col("path"))))
    head = F.min(F.struct("path", "line", "lang", (F.col("end_line") + 1 - F.col("line")).alias("lines"), F.coalesce("nodes", F.lit(0)).alias("nodes"), "class"))
    g = rows.groupBy("norm_hash").agg(F.count(F.lit(1)).alias("copies"), head.alias("h"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.bool_or("shown").alias("shown")).where("copies >= 2")
    out = g.select(
        "norm_hash", "h.lang", "copies", "h.lines", "h.nodes", (F.col("h.nodes") * (F.col("copies") - 1)).alias("saves_nodes"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("population"), "h.path", "h.line", "shown", F.col("h.class").alias("first_class"),
    )
    hidden = out.where(~F.col("shown")).groupBy(F.col("first_class").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return out.where("shown").drop("shown", "first_class"), hidden


def members(units: DataFrame, found: DataFrame, *, scope: str | None = None, min_lines: int = MIN_LINES) -> DataFrame:
    """The members of each found group: norm_hash, path, line, end_line, id."""
    rows = candidates(units, scope, min_lines).select("norm_hash", "path", "line", "end_line", "id")
    return rows.join(found.select("norm_hash"), "norm_hash", "left_semi")


def ranked(found: DataFrame) -> DataFrame:
    """Report order: app and mixed first, then by what is saved, then by place."""
    return found.orderBy(~F.col("population").isin("app", "mixed"), F.desc("saves_nodes"), "path", "line")


def near_groups(pairs: DataFrame, units: DataFrame, policy: Policy | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, withheld) of near pairs (a, b, similarity, shared_nodes), in the columns of `groups`.

    A group is the first unit of each body; what merging saves is the shared nodes.  It is
    withheld like an exact group.
    """
    policy = policy or Policy()
    lines = F.col("end_line") + 1 - F.col("line")
    first = F.min(F.struct("path", "line", "lang", lines.alias("lines"), F.coalesce("nodes", F.lit(0)).alias("nodes"), "class"))
    u = units.withColumn("class", policy.of_unit(F.col("path"), F.col("lang"), F.col("owner"))).groupBy("norm_hash").agg(first.alias("u"))
    side = lambda s: u.select(F.col("norm_hash").alias(s), F.col("u").alias(f"u{s}"))
    g = pairs.join(side("a"), "a").join(side("b"), "b")
    shown = policy.reported(policy.of(F.col("ua.path"))) | policy.reported(policy.of(F.col("ub.path")))
    out = g.select(
        F.col("a").alias("norm_hash"), F.col("b").alias("other"), "ua.lang", F.lit(2).cast("long").alias("copies"), "ua.lines", "ua.nodes", F.col("shared_nodes").cast("long").alias("saves_nodes"),
        F.when(F.col("ua.class") == F.col("ub.class"), F.col("ua.class")).otherwise("mixed").alias("population"), "ua.path", "ua.line", "similarity", shown.alias("shown"), F.col("ua.class").alias("first_class"),
    )
    hidden = out.where(~F.col("shown")).groupBy(F.col("first_class").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return out.where("shown").drop("shown", "first_class"), hidden


def united(exact_groups: DataFrame, near_found: DataFrame) -> DataFrame:
    """Groups of both tiers as one list: tier is 'exact' or 'near'; other and similarity are null for exact groups."""
    e = exact_groups.withColumn("tier", F.lit("exact")).withColumn("other", F.lit(None).cast("string")).withColumn("similarity", F.lit(None).cast("double"))
    return e.unionByName(near_found.withColumn("tier", F.lit("near")))


def merged_withheld(a: DataFrame, b: DataFrame) -> DataFrame:
    """(class, n) of what two tiers withheld together."""
    return a.unionByName(b).groupBy("class").agg(F.sum("n").alias("n"))
