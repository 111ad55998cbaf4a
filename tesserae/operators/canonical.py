"""Which member of a group is the canonical one, from independent signals.

Three signals: age (decides, lowest wins), references (decides, highest wins) and namespace
depth (a tiebreak, lowest wins).  A signal speaks only if every member could be measured and
one member alone holds the best value.  Deciding signals that agree pick; that disagree pick
nobody; if none speaks, the tiebreak picks on a weak basis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIDING, TIEBREAK = ("age", "references"), ("depth",)


def depth(unit_id: Column) -> Column:
    """How deep a unit's owner is: parts before the last '#' or '.', by '::'."""
    owner = F.regexp_extract(unit_id, r"^(.*)[#.][^#.]*$", 1)
    return F.when(owner == "", 0).otherwise(F.size(F.split(owner, "::")))


def signals(members: DataFrame) -> DataFrame:
    """(grp, signal, pick, value) for members (grp, member, age, confirmed, possible, depth).

    Null age, or null confirmed or possible counts, is "could not be measured", which is not
    zero.  References compare confirmed counts if any member has some, else possible ones.
    """
    totals = members.groupBy("grp").agg(F.max(F.coalesce("confirmed", F.lit(0))).alias("any_confirmed"))
    m = members.join(totals, "grp").withColumn("references", F.when(F.col("confirmed").isNotNull() & F.col("possible").isNotNull(), F.when(F.col("any_confirmed") > 0, F.col("confirmed")).otherwise(F.col("possible"))))
    long = m.select("grp", "member", F.explode(F.map_from_arrays(F.array(F.lit("age"), F.lit("references"), F.lit("depth")), F.array(F.col("age").cast("long"), -F.col("references").cast("long"), F.col("depth").cast("long")))).alias("signal", "v"))
    best = long.groupBy("grp", "signal").agg(F.min("v").alias("best"), F.count_if(F.col("v").isNull()).alias("missing"))
    # who holds the best value, and how many do
    held = long.join(best, ["grp", "signal"]).where((F.col("missing") == 0) & (F.col("v") == F.col("best"))).groupBy("grp", "signal").agg(F.count(F.lit(1)).alias("holders"), F.min("member").alias("pick"), F.min("best").alias("best"))
    return best.select("grp", "signal").join(held, ["grp", "signal"], "left").select("grp", "signal", F.when(F.col("holders") == 1, F.col("pick")).alias("pick"), F.when(F.col("signal") == "references", -F.col("best")).otherwise(F.col("best")).alias("value"))


def canonical(members: DataFrame) -> DataFrame:
    """(grp, pick, basis): basis is 'agree', 'disagree', 'weak' or 'nothing'."""
    s = signals(members)
    decides = F.col("signal").isin(*DECIDING)
    g = s.groupBy("grp").agg(
        F.min(F.when(decides, F.col("pick"))).alias("lo"), F.max(F.when(decides, F.col("pick"))).alias("hi"), F.max(F.when(F.col("signal").isin(*TIEBREAK), F.col("pick"))).alias("weak"),
    )
    basis = F.when(F.col("lo").isNotNull(), F.when(F.col("lo") == F.col("hi"), "agree").otherwise("disagree")).when(F.col("weak").isNotNull(), "weak").otherwise("nothing")
    return g.withColumn("basis", basis).select("grp", F.when(F.col("basis") == "agree", F.col("lo")).when(F.col("basis") == "weak", F.col("weak")).alias("pick"), "basis")


def runner_up(members: DataFrame, value: str) -> DataFrame:
    """(grp, best, margin): the least value, and how far the next member is from it."""
    from pyspark.sql import Window

    r = members.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(value, "member"))).where("_r <= 2")
    return r.groupBy("grp").agg(F.min(value).alias("best"), (F.max(value) - F.min(value)).alias("margin"))
