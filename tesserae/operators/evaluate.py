"""Scoring queries against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round2


def labelled_rank(ranking: DataFrame, labels: DataFrame, known_ids: DataFrame) -> DataFrame:
    """One row (top1, top5, found, total, unknown) for ranking (query_id, id, rank) and labels (query_id, expected)."""
    at = labels.join(ranking, (labels["query_id"] == ranking["query_id"]) & (labels["expected"] == ranking["id"]), "left").select(labels["query_id"], "expected", "rank")
    ids = known_ids.select(F.col("id").alias("expected")).distinct().withColumn("_known", F.lit(True))
    r = at.join(ids, "expected", "left")
    ok = F.col("_known").isNotNull()
    return r.agg(F.count_if(ok & (F.col("rank") == 1)).alias("top1"), F.count_if(ok & (F.col("rank") <= 5)).alias("top5"), F.count_if(ok & F.col("rank").isNotNull()).alias("found"), F.count_if(ok).alias("total"), F.count_if(~ok).alias("unknown"))


def overlap_ranking(units: DataFrame, queries: DataFrame) -> DataFrame:
    """The baseline (query_id, unit, hits, rank): units by how many distinct query tokens their text has.

    units: unit, lines, tokens; queries: query_id, tokens.  More hits first, then shorter, then
    the order of units.
    """
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("t"))
    u = units.select("unit", "lines", F.explode(F.array_distinct("tokens")).alias("t"))
    hits = u.join(q, "t").groupBy("query_id", "unit", "lines").agg(F.count(F.lit(1)).alias("hits"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "lines", "unit"))).select("query_id", "unit", "hits", "rank")


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")


def scored_pairs(reported: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (a, b, is_true) with the similarity reported for the pair in either order, or null."""
    r = reported.select(*pair_key(F.col("a"), F.col("b")), "similarity").groupBy("lo", "hi").agg(F.max("similarity").alias("similarity"))
    return labels.select(*pair_key(F.col("a"), F.col("b")), "is_true").join(r, ["lo", "hi"], "left")


def confusion(scored: DataFrame, hit: Column | None = None) -> DataFrame:
    """One row (tp, fp, fn, tn) of pairs (is_true, similarity); a pair counts as reported if `hit`."""
    hit = F.col("similarity").isNotNull() if hit is None else hit
    return scored.agg(F.count_if(F.col("is_true") & hit).alias("tp"), F.count_if(~F.col("is_true") & hit).alias("fp"), F.count_if(F.col("is_true") & ~hit).alias("fn"), F.count_if(~F.col("is_true") & ~hit).alias("tn"))


def sweep(scored: DataFrame, lo: int = 25, hi: int = 95, step: int = 5) -> DataFrame:
    """(threshold, tp, fp, fn) for thresholds in hundredths; the pairs are few, being labels."""
    t = scored.sparkSession.range(lo, hi + 1, step).select((F.col("id") / 100).alias("threshold"))
    hit = F.coalesce(F.col("similarity") >= F.col("threshold"), F.lit(False))
    return scored.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if(F.col("is_true") & hit).alias("tp"), F.count_if(~F.col("is_true") & hit).alias("fp"), F.count_if(F.col("is_true") & ~hit).alias("fn"))


def distribution(values: DataFrame, value: str) -> DataFrame:
    """One row (n, min, mean, max), two decimals; zeros for none."""
    zero = lambda c: F.coalesce(round2(c), F.lit(0.0))
    return values.agg(F.count(value).alias("n"), zero(F.min(value)).alias("min"), zero(F.avg(value)).alias("mean"), zero(F.max(value)).alias("max"))


def floors(answers: DataFrame, distractors: DataFrame, value: str = "cosine") -> DataFrame:
    """(floor, answers_kept, distractors_cut) for floors from 0.00 to 0.50 in steps of 0.05."""
    t = F.broadcast(answers.sparkSession.range(0, 51, 5).select((F.col("id") / 100).alias("floor")))
    a = answers.select(F.col(value).alias("v"), F.lit(True).alias("is_answer")).unionByName(distractors.select(F.col(value).alias("v"), F.lit(False).alias("is_answer")))
    return a.crossJoin(t).groupBy("floor").agg(F.count_if(F.col("is_answer") & (F.col("v") >= F.col("floor"))).alias("answers_kept"), F.count_if(~F.col("is_answer") & (F.col("v") < F.col("floor"))).alias("distractors_cut"))


def best_distractor(scores: DataFrame, labels: DataFrame, value: str = "cosine") -> DataFrame:
    """(query_id, best): the highest value that an id other than the expected one has, null if there is none."""
    r = scores.join(labels.select("query_id", "expected"), "query_id")
    return r.groupBy("query_id").agg(F.max(F.when(F.col("id") != F.col("expected"), F.col(value))).alias("best"))


TIER_STRENGTH = {"structural": 0, "near": 1, "semantic": 2}


def similar_score(found: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (probe, neighbour, rule, tier) with ok: rule 'must' wants the neighbour in that tier, 'must_not' in none as strong."""
    strength = lambda c: F.when(c == "structural", 0).when(c == "near", 1).when(c == "semantic", 2).otherwise(3)
    r = labels.join(found.select("probe", "neighbour", F.col("tier").alias("got")), ["probe", "neighbour"], "left")
    got, want = strength(F.col("got")), F.when(F.col("tier").isNull(), 2).otherwise(strength(F.col("tier")))
    return r.withColumn("ok", F.when(F.col("rule") == "must", F.coalesce(F.col("got") == F.col("tier"), F.lit(False))).otherwise(got > want))


def canonical_score(picks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (correct, wrong, abstained) for picks (grp, pick) and labels (grp, expected)."""
    r = labels.join(picks.select("grp", "pick"), "grp", "left")
    return r.agg(F.count_if(F.col("pick") == F.col("expected")).alias("correct"), F.count_if(F.col("pick") != F.col("expected")).alias("wrong"), F.count_if(F.col("pick").isNull()).alias("abstained"))


def tier_score(reported: DataFrame, labels: DataFrame, known: DataFrame, min_lines: int = 0) -> DataFrame:
    """One row (tp, fp, fn, unknown, smallest_true, largest_false) of a tier.

    reported: a, b, lines, in either order; labels: a, b, is_true; known: id.  A pair of which
    one side isn't known counts as unknown only.  A pair below min_lines isn't reported.
    smallest_true and largest_false are lines, null if there is no such pair.
    """
    r = reported.select(*pair_key(F.col("a"), F.col("b")), "lines").groupBy("lo", "hi").agg(F.max("lines").alias("lines"))
    ids = known.select("id").distinct()
    sides = [ids.select(F.col("id").alias(k), F.lit(True).alias(f"has_{k}")) for k in ("lo", "hi")]
    rows = labels.select(*pair_key(F.col("a"), F.col("b")), "is_true").join(r, ["lo", "hi"], "left")
    for s, k in zip(sides, ("lo", "hi"), strict=True):
        rows = rows.join(s, k, "left")
    ok = F.col("has_lo").isNotNull() & F.col("has_hi").isNotNull()
    hit, true = F.coalesce(F.col("lines") >= min_lines, F.lit(False)), F.col("is_true")
    return rows.agg(
        F.count_if(ok & true & hit).alias("tp"), F.count_if(ok & ~true & hit).alias("fp"), F.count_if(ok & true & ~hit).alias("fn"), F.count_if(~ok).alias("unknown"),
        F.min(F.when(ok & true & hit, F.col("lines"))).alias("smallest_true"), F.max(F.when(ok & ~true & hit, F.col("lines"))).alias("largest_false"),
    )


def measured_sweep(scored: DataFrame, measures: tuple[str, ...] = ("nodes", "shapes"), lo: int = 25, hi: int = 95, step: int = 5) -> DataFrame:
    """(measure, threshold, tp, fp, fn, short_found, short_total, short_false) of each measure and threshold.

    scored: is_true, short, and a column for each measure.  Short labels count in all columns,
    and by themselves in the last three.
    """
    t = F.broadcast(scored.sparkSession.range(lo, hi + 1, step).select((F.col("id") / 100).alias("threshold")))
    long = scored.select("is_true", "short", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("m"))
    hit, true, short = F.coalesce(F.col("m.v") >= F.col("threshold"), F.lit(False)), F.col("is_true"), F.col("short")
    return long.crossJoin(t).groupBy(F.col("m.measure").alias("measure"), "threshold").agg(
        F.count_if(true & hit).alias("tp"), F.count_if(~true & hit).alias("fp"), F.count_if(true & ~hit).alias("fn"),
        F.count_if(short & true & hit).alias("short_found"), F.count_if(short & true).alias("short_total"), F.count_if(short & ~true & hit).alias("short_false"),
    )


def signal_score(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """(signal, correct, wrong, silent) of signals (grp, signal, pick) on labels (grp, expected)."""
    r = signals.join(labels.select("grp", "expected"), "grp")
    right = F.col("pick") == F.col("expected")
    return r.groupBy("signal").agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong"), F.count_if(F.col("pick").isNull()).alias("silent"))


def rate(part: int, of: int) -> str:
    """A share with its denominator; n/a of nothing."""
    return f"{part}/{of} ({100 * part / of:.0f} %)" if of else "n/a"
