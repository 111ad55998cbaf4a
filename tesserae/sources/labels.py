"""Label files and answer fixtures: loud about rows that can't be meant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summary import SCHEMA

#: The columns of each kind of label file and its closed words.
KINDS = {
    "queries": (("query", "expected"), {}),
    "pairs": (("a", "b", "kind"), {"kind": ("duplicate", "near", "distinct")}),
    "canonical": (("canonical", "alternate", "evidence"), {}),
    "similar": (("probe", "rule", "neighbour", "tier"), {"rule": ("must", "must_not"), "tier": ("structural", "near", "semantic", "")}),
}
EVIDENCE = ("older", "delegates", "mirrors", "ex_subclass")


class LabelError(ValueError):
    """A label file with a row that its grammar doesn't allow."""


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(line, cells) of a tab-separated file, without blank lines and comments.

    The line number is the place of the line in its file; label files are small.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return lines.where((F.trim("text") != "") & ~F.ltrim(F.col("text")).startswith("#")).select((F.col("line") + 1).alias("line"), F.split("text", "\t").alias("cells"))


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A label file of a kind in KINDS, with `provisional`; a bad row is an error that names its line."""
    columns, words = KINDS[kind]
    cells = F.transform("cells", lambda c: F.trim(c))
    r = rows(spark, path).select("line", F.filter(cells, lambda c: c != "provisional").alias("cells"), F.array_contains(cells, "provisional").alias("provisional"))
    out = r.select("line", F.size("cells").alias("n"), *[F.coalesce(F.get("cells", i), F.lit("")).alias(c) for i, c in enumerate(columns)], "provisional")
    least = len(columns) - (kind == "similar")
    wrong = ~F.col("n").between(least, len(columns))
    for c in columns[:least]:
        wrong |= F.col(c) == ""
    for c, allowed in words.items():
        wrong |= ~F.col(c).isin(*allowed)
    if kind == "canonical":
        wrong |= F.size(F.array_except(F.split("evidence", ","), F.array(*[F.lit(e) for e in EVIDENCE]))) > 0
    if kind == "similar":
        wrong |= (F.col("rule") == "must") & (F.col("tier") == "")
    bad = out.where(wrong).orderBy("line").limit(1).collect()
    if bad:
        raise LabelError(f"{path}:{bad[0]['line']}: not a row of {kind}: {', '.join(columns)}")
    return out.drop("n")


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(id, summary) from a JSON object of summaries by unit id."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{SCHEMA.replace(' string', ':string').replace(' array<', ':array<')}>>", {"mode": "FAILFAST"}).alias("m"))
    return text.select(F.explode("m").alias("id", "summary"))
