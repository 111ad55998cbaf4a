"""Constant caveats: copies that read one name under different nestings may mean different constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(points: DataFrame, spans: DataFrame, key: str, at: str, lo: str, hi: str, width: int = 256) -> DataFrame:
    """Points of the same key that lie in a span, both ends included.

    Both sides are dealt by key and bucket of `width`, a span to every bucket that it touches, so a
    point meets only spans that are near it, and a key with many rows is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    touched = spans.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return touched.join(points.withColumn("_bucket", bucket(at)), [key, "_bucket"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bucket")


def ancestors(nesting: Column) -> Column:
    """A nesting, its enclosing ones, and the top level (empty), innermost first."""
    parts = F.split(nesting, "::")
    inner = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    return F.when(F.coalesce(nesting, F.lit("")) == "", F.array(F.lit(""))).otherwise(F.concat(inner, F.array(F.lit(""))))


def resolved(reads: DataFrame, definitions: DataFrame) -> DataFrame:
    """reads (name, nesting, ...) with `reached`: the innermost scope around that defines the name, or null.

    Each read asks for its few ancestors by equality, so no prefix comparison is needed.
    """
    asked = reads.select("name", "nesting").distinct().select("name", "nesting", F.posexplode(ancestors(F.col("nesting"))).alias("out", "at"))
    hit = asked.join(definitions.select("name", F.col("parent").alias("at")).distinct(), ["name", "at"])
    best = hit.groupBy("name", "nesting").agg(F.min_by("at", "out").alias("reached"))
    return reads.join(best, ["name", "nesting"], "left")


def caveats(members: DataFrame, reads: DataFrame, definitions: DataFrame) -> DataFrame:
    """(grp, name) for groups whose copies read a name that means different things in them.

    members: grp, path, line, end_line, owner.  reads: path, name, nesting, at (a line).
    definitions: name, parent.  Only names without '::', read under two nestings and more in a
    group of two owners and more, and reaching more than one definition.
    """
    owners = members.groupBy("grp").agg(F.countDistinct("owner").alias("n")).where("n >= 2").select("grp")
    inside = within(reads.where(~F.contains("name", F.lit("::"))), members.join(owners, "grp", "left_semi").select("grp", "path", "line", "end_line"), "path", "at", "line", "end_line")
    two = inside.groupBy("grp", "name").agg(F.countDistinct("nesting").alias("n")).where("n >= 2").select("grp", "name")
    found = resolved(inside.join(two, ["grp", "name"], "left_semi").select("grp", "name", "nesting").distinct(), definitions)
    return found.groupBy("grp", "name").agg(F.countDistinct("reached").alias("n")).where("n > 1").select("grp", "name")


def oldest(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, line, end_line, age): the least author time of the lines (path, at, time) of each span; null if none is known."""
    s = spans.select("path", "line", "end_line").distinct()
    m = within(lines.select("path", "at", "time"), s, "path", "at", "line", "end_line").groupBy("path", "line", "end_line").agg(F.min("time").alias("age"))
    return s.join(m, ["path", "line", "end_line"], "left")


def definitions(answers: DataFrame) -> DataFrame:
    """(name, status, parents) of a definition finder's JSON answers (name, json).

    status 'found': parents are the distinct scopes that define exactly this name, the top
    level being empty.  An object saying no_match is 'none', a true zero.  Anything else is
    'unavailable', which is not zero.
    """
    rows = F.from_json("json", "array<struct<name:string,parent:string>>")
    isarray = F.coalesce(F.ltrim(F.col("json")).startswith("["), F.lit(False)) & rows.isNotNull() & F.coalesce(F.json_array_length("json").isNotNull(), F.lit(False))
    own = F.array_sort(F.array_distinct(F.transform(F.filter(rows, lambda r: r["name"] == F.col("name")), lambda r: F.coalesce(r["parent"], F.lit("")))))
    missed = F.get_json_object("json", "$.status") == "no_match"
    status = F.when(isarray, "found").when(F.coalesce(missed, F.lit(False)), "none").otherwise("unavailable")
    none = F.array().cast("array<string>")
    return answers.select("name", status.alias("status"), F.when(isarray, own).otherwise(none).alias("parents"))


def references(answers: DataFrame) -> DataFrame:
    """(id, confirmed, possible, reason) of a reference counter's JSON answers (id, json); nulls with a reason if it gave none."""
    field = lambda p: F.get_json_object("json", p)
    c, p = field("$.counts.confirmed").cast("long"), field("$.counts.possible").cast("long")
    why, hint = field("$.reason"), field("$.hint")
    told = why.isNull() & c.isNotNull() & p.isNotNull()
    reason = F.when(why.isNotNull(), F.concat_ws("; ", why, hint)).when(~told, "no counts")
    return answers.select("id", F.when(told, c).alias("confirmed"), F.when(told, p).alias("possible"), reason.alias("reason"))
