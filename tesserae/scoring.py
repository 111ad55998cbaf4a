"""How well the answers about a checkout fit labels: one report of rates with their denominators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text
from .functions.vectors import cosine
from .operators import canonical, evaluate, exact, near
from .sources import ingest, labels
from .workspace import SIGNATURE, Workspace


def score(w: Workspace, folder: str, min_lines: int = exact.MIN_LINES) -> dict:
    """The report on the label files that a folder has: dupes, near, sweep, canonical, similar, ranking."""
    at = {k: f"{folder}/{k}.tsv" for k in labels.KINDS if (Path(folder) / f"{k}.tsv").exists()}
    out: dict = {}
    if "pairs" in at:
        out |= _pairs(w, labels.load(w.spark, at["pairs"], "pairs"), min_lines)
    if "canonical" in at:
        out["canonical"] = _canonical(w, labels.load(w.spark, at["canonical"], "canonical"))
    if "similar" in at:
        out["similar"] = _similar(w, labels.load(w.spark, at["similar"], "similar"))
    if "queries" in at:
        out["ranking"] = _ranking(w, labels.load(w.spark, at["queries"], "queries"))
    return out


def rates(row: dict) -> dict:
    """Counts with precision and recall beside them; n/a where nothing was counted."""
    return row | {"precision": evaluate.rate(row["tp"], row["tp"] + row["fp"]), "recall": evaluate.rate(row["tp"], row["tp"] + row["fn"])}


def _ends(bodies: DataFrame, a: Column, b: Column, pairs: DataFrame, *rest: str) -> DataFrame:
    """pairs of bodies as (a, b, ...) pairs of the ids that have them; labelled ids only, so never all copies by all copies."""
    left, right = bodies.select(F.col("id").alias("ia"), F.col("norm_hash").alias("ha")), bodies.select(F.col("id").alias("ib"), F.col("norm_hash").alias("hb"))
    return pairs.join(left, a == F.col("ha")).join(right, b == F.col("hb")).where("ia <> ib").select(F.col("ia").alias("a"), F.col("ib").alias("b"), *rest)


def _pairs(w: Workspace, given: DataFrame, min_lines: int) -> dict:
    units = exact.candidates(w.units(), None, 1)
    wanted = given.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # a label's id means its first unit
    named = near.representatives(units.select(F.col("id").alias("norm_hash"), "path", "line", "end_line", F.col("norm_hash").alias("body"))).withColumnsRenamed({"norm_hash": "id", "body": "norm_hash"}).join(wanted, "id", "left_semi")
    known = w.units().select("id").distinct()
    lines = (F.col("end_line") + 1 - F.col("line")).alias("lines")
    same = given.join(named.select(F.col("id").alias("a"), F.col("norm_hash").alias("ha"), lines), "a").join(named.select(F.col("id").alias("b"), F.col("norm_hash").alias("hb")), "b")
    reported = same.where("ha = hb").select("a", "b", "lines")
    dupes = evaluate.tier_score(reported, given.select("a", "b", (F.col("kind") == "duplicate").alias("is_true")), known, min_lines).first().asDict()
    sig = w._read("signature", SIGNATURE)
    bodies = named.select("norm_hash").distinct()
    close = near.covered(sig, near.pairs(sig, bodies, 0.0))
    ours = given.where("kind <> 'duplicate'").select("a", "b", (F.col("kind") == "near").alias("is_true"))
    both = _ends(named, F.col("a"), F.col("b"), close.withColumnsRenamed({"similarity": "shapes", "node_ratio": "nodes"}), "nodes", "shapes")
    hit = both.where(F.col("shapes") >= near.THRESHOLD_F32).join(named.select(F.col("id").alias("a"), lines), "a")
    tier = evaluate.tier_score(hit, ours, known, min_lines).first().asDict()
    keyed = both.select(*evaluate.pair_key(F.col("a"), F.col("b")), "nodes", "shapes").groupBy("lo", "hi").agg(F.max("nodes").alias("nodes"), F.max("shapes").alias("shapes"))
    equal = reported.select(*evaluate.pair_key(F.col("a"), F.col("b")), F.lit(1.0).alias("nodes"), F.lit(1.0).alias("shapes"))
    there = ours.join(named.select(F.col("id").alias("a")), "a", "left_semi").join(named.select(F.col("id").alias("b")), "b", "left_semi")
    scored = there.select(*evaluate.pair_key(F.col("a"), F.col("b")), "is_true").join(keyed.unionByName(equal).dropDuplicates(["lo", "hi"]), ["lo", "hi"], "left").na.fill(0.0, ["nodes", "shapes"])
    small = units.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.col("end_line") + 1 - F.col("line")).alias("n")).where(F.col("n") < min_lines).select("id")
    tagged = scored.join(small.select(F.col("id").alias("lo"), F.lit(True).alias("sl")), "lo", "left").join(small.select(F.col("id").alias("hi"), F.lit(True).alias("sh")), "hi", "left")
    tagged = tagged.withColumn("short", F.col("sl").isNotNull() | F.col("sh").isNotNull())
    points = [r.asDict() for r in evaluate.measured_sweep(tagged).orderBy("measure", "threshold").collect()]
    return {"dupes": rates(dupes), "near": rates(tier), "sweep": points}


def _canonical(w: Workspace, given: DataFrame) -> dict:
    first = near.representatives(w.units().select(F.col("id").alias("norm_hash"), "path", "line", "end_line")).withColumnRenamed("norm_hash", "id")
    edges = given.select(F.monotonically_increasing_id().alias("grp"), "canonical", "alternate")
    members = edges.select("grp", F.explode(F.array("canonical", "alternate")).alias("id")).join(first, "id")
    whole = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("grp")
    times = ingest.blamed(w.spark, w.root, members)
    from .operators.caveat import oldest

    m = members.join(whole, "grp", "left_semi").join(oldest(members, times), ["path", "line", "end_line"], "left")
    none = F.lit(None).cast("long")
    m = m.select("grp", F.col("id").alias("member"), "age", none.alias("confirmed"), none.alias("possible"), canonical.depth(F.col("id")).alias("depth"))
    judged = edges.join(whole, "grp", "left_semi").select("grp", F.col("canonical").alias("expected"))
    row = evaluate.canonical_score(canonical.canonical(m), judged).first().asDict()
    by = evaluate.signal_score(canonical.signals(m), judged).orderBy("signal").collect()
    n = edges.count()
    unknown = n - row["correct"] - row["wrong"] - row["abstained"]
    return row | {"unknown": unknown, "signals": [r.asDict() for r in by], "right": evaluate.rate(row["correct"], row["correct"] + row["wrong"])}


def _similar(w: Workspace, given: DataFrame) -> dict:
    """Each labelled probe is asked once; labels are few."""
    got = []
    for r in given.select("probe").distinct().orderBy("probe").toLocalIterator():
        try:
            got += [(r["probe"], n["id"], n["tier"]) for n in w.similar(r["probe"]).join(w.units().select("path", "line", "id"), ["path", "line"]).select("id", "tier").collect()]
        except LookupError:
            continue
    found = w.spark.createDataFrame(got, "probe string, neighbour string, tier string")
    rules = given.select("probe", "neighbour", "rule", F.when(F.col("tier") != "", F.col("tier")).alias("tier"))
    r = evaluate.similar_score(found, rules).groupBy("rule").agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("n")).orderBy("rule").collect()
    return {x["rule"]: evaluate.rate(x["ok"], x["n"]) for x in r}


def _ranking(w: Workspace, given: DataFrame) -> dict:
    """All labelled queries in one search, against overlap of words alone, and how near answers and distractors are."""
    from .functions.vectors import hash_embed, shortened
    from .operators import search

    units = w.embedded(w.units())
    asked = given.select(F.col("line").alias("query_id"), "query", "expected")
    q = asked.withColumn("raw", hash_embed("query")).select("query_id", text.tokens(F.col("query")).alias("tokens"), shortened(F.col("raw")).alias("vec"))
    ids = units.select("unit", "id")
    ranked = search.search(units, q, w.policy, floor=0.0, limit=100).select("query_id", "unit", "rank").join(ids, "unit")
    plain = evaluate.overlap_ranking(units.select("unit", (F.col("end_line") + 1 - F.col("line")).alias("lines"), "tokens"), q).join(ids, "unit")
    out = {}
    for name, r in (("best", ranked), ("words", plain)):
        best = r.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
        row = evaluate.labelled_rank(best, asked.select("query_id", "expected"), units.select("id")).first().asDict()
        out[name] = row | {"first": evaluate.rate(row["top1"], row["total"]), "first_five": evaluate.rate(row["top5"], row["total"])}
    near_by = ranked.where("rank <= 100").select("query_id", "unit", "id").join(units.select("unit", F.col("vec").alias("v")), "unit").join(q.select("query_id", "vec"), "query_id").select("query_id", "id", cosine(F.col("v"), F.col("vec")).alias("cosine"))
    answers = near_by.join(asked, "query_id").where("id = expected").select("cosine")
    others = evaluate.best_distractor(near_by, asked).where("best IS NOT NULL").select(F.col("best").alias("cosine"))
    out["answers"], out["distractors"] = (evaluate.distribution(x, "cosine").first().asDict() for x in (answers, others))
    out["floors"] = [r.asDict() for r in evaluate.floors(answers, others).orderBy("floor").collect()]
    return out
