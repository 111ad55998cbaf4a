"""Units, files and vectors as tables: the joins every query begins with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import qualified_owner, under
from ..functions.text import unit_id


def located(files: DataFrame, units: DataFrame, *, root: str | None = None, scope: str | None = None) -> DataFrame:
    """file (root, path, oid) with its units: one row for each unit at each path that holds its blob."""
    f = files.where((F.col("root") == root) if root is not None else F.lit(True)).where(under(F.col("path"), scope))
    rows = f.join(units, "oid").withColumn("lang", F.coalesce("lang", F.lit("ruby")))
    rows = rows.withColumn("owner", qualified_owner(F.col("lang"), F.col("path"), F.col("owner")))
    return rows.withColumn("id", unit_id(F.col("lang"), F.col("owner"), F.col("name"), F.col("singleton")))


def status(checkouts: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """(root, files, blobs, units) of each checkout; a blob's units count at each of its paths."""
    return status_of_counts(checkouts, files, units.groupBy("oid").agg(F.count(F.lit(1)).alias("n")))


def status_of_counts(checkouts: DataFrame, files: DataFrame, per_blob: DataFrame) -> DataFrame:
    """`status` for the number of units (oid, n) of each blob."""
    rows = files.join(per_blob, "oid", "left")
    g = rows.groupBy("root").agg(F.count("path").alias("files"), F.countDistinct("oid").alias("blobs"), F.coalesce(F.sum("n"), F.lit(0)).alias("units"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return checkouts.select("root").join(g, "root", "left").select("root", zero("files"), zero("blobs"), zero("units"))


def known(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted oids that are stored."""
    return wanted.select("oid").distinct().join(blobs, "oid", "left_semi")


def to_parse(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(oid, path): one path for each blob that isn't stored yet."""
    return files.groupBy("oid").agg(F.min("path").alias("path")).join(blobs.select("oid"), "oid", "left_anti")


def distinct_texts(units: DataFrame) -> DataFrame:
    """(text_key, text, first): each text to embed once, with the first unit that has it; blank texts have none."""
    return units.where(F.trim("text") != "").groupBy("text_key").agg(F.min_by("text", "unit").alias("text"), F.min("unit").alias("first"))


def missing_vectors(units: DataFrame, vectors: DataFrame, config_key: int) -> DataFrame:
    """Distinct texts without a vector under this configuration."""
    return distinct_texts(units).join(vectors.where(F.col("config_key") == config_key).select("text_key"), "text_key", "left_anti")


def with_vectors(units: DataFrame, vectors: DataFrame, config_key: int) -> DataFrame:
    """units with vec, null where there is none: only vectors that units want are read."""
    v = vectors.where(F.col("config_key") == config_key).select("text_key", "vec")
    return units.join(v.join(units.select("text_key").distinct(), "text_key", "left_semi"), "text_key", "left")


def put_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """The vector table after storing `new`: newer rows replace older ones of the same key."""
    r = F.row_number().over(Window.partitionBy("config_key", "text_key").orderBy(F.desc("_new")))
    return vectors.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("_r", r).where("_r = 1").drop("_r", "_new")


def tiers(units: DataFrame) -> DataFrame:
    """One row: how many vectors stand for summaries and how many for identifiers."""
    return units.where(F.col("vec").isNotNull()).agg(F.count_if(F.col("vec_via") == "summary").alias("summary"), F.count_if(F.col("vec_via") != "summary").alias("identifier"))


def named(units: DataFrame, name: str) -> DataFrame:
    """Located units of a bare name, whoever owns them."""
    return units.where(F.col("name") == name)


def holding(checkouts: DataFrame, path: str | None = None) -> DataFrame:
    """The checkouts (root, ...) whose folder a path is in; all of them without a path."""
    return checkouts if path is None else checkouts.where((F.lit(path) == F.col("root")) | F.startswith(F.lit(path), F.concat("root", F.lit("/"))))
