"""The life of bought answers: what is wanted, what is there, what may be stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields of a summary, its closed vocabulary, and the schema.
FIELDS = ("summary", "primary_purpose", "secondary_concerns", "side_effects", "domain", "patterns")
SIDE_EFFECTS = ("persists", "network", "filesystem", "mutates", "observes", "raises", "spawns")
SCHEMA = "summary string, primary_purpose string, secondary_concerns array<string>, side_effects array<string>, domain string, patterns array<string>"
KEY = ("norm_hash", "ctx_hash", "prompt", "model", "via", "variant", "level")


def decoded(json: Column) -> Column:
    """A stored summary; side effects outside the vocabulary read as 'other'."""
    s = F.from_json(json, SCHEMA)
    known = lambda e: F.when(e.isin(*SIDE_EFFECTS), e).otherwise("other")
    return s.withField("side_effects", F.transform(s["side_effects"], known))


def valid(s: Column) -> Column:
    """Whether a summary may be stored: its three texts aren't blank and no side effect is 'other'."""
    full = lambda c: F.coalesce(F.trim(s[c]) != "", F.lit(False))
    return full("summary") & full("primary_purpose") & full("domain") & ~F.array_contains(F.coalesce(s["side_effects"], F.array().cast("array<string>")), "other")


def acceptable(json: Column) -> Column:
    """Whether a contributed text is exactly a summary: an object of the six fields and no others."""
    names = F.json_object_keys(json)
    exact = (F.size(names) == len(FIELDS)) & (F.size(F.array_except(names, F.array(*[F.lit(f) for f in FIELDS]))) == 0)
    return F.coalesce(exact & valid(decoded(json)), F.lit(False))


def latest(summaries: DataFrame) -> DataFrame:
    """(norm_hash, ctx_hash, json): the newest answer of any model; equal times go to the larger text."""
    return summaries.groupBy("norm_hash", "ctx_hash").agg(F.max(F.struct("created_at", "json")).alias("m")).select("norm_hash", "ctx_hash", "m.json")


def sources(summaries: DataFrame) -> DataFrame:
    return summaries.select("model", "via").distinct()


def bought(summaries: DataFrame, prompt: str, model: str, via: str) -> DataFrame:
    """The (norm_hash, ctx_hash) that this prompt, model and way have answered for whole units."""
    return summaries.where((F.col("prompt") == prompt) & (F.col("model") == model) & (F.col("via") == via) & (F.col("variant") == "body") & (F.col("level") == "unit")).select("norm_hash", "ctx_hash").distinct()


def upserted(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """The table after storing the acceptable rows of `new`: for each key the newest row stays."""
    good = new.where(acceptable(F.col("json")))
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("created_at"), F.desc("_new"), F.desc("json")))
    return summaries.withColumn("_new", F.lit(0)).unionByName(good.withColumn("_new", F.lit(1))).withColumn("_r", newest).where("_r = 1").drop("_r", "_new")


def coverage(units: DataFrame, answered: DataFrame) -> DataFrame:
    """One row (summarizable, summarized, state) for units (norm_hash, ctx_hash) and the keys answered."""
    a = answered.select("norm_hash", "ctx_hash").distinct().withColumn("_has", F.lit(True))
    c = units.where(F.col("norm_hash").isNotNull()).join(a, ["norm_hash", "ctx_hash"], "left").agg(F.count(F.lit(1)).alias("summarizable"), F.count("_has").alias("summarized"))
    return c.withColumn("state", F.when(F.col("summarized") == 0, "none").when(F.col("summarized") < F.col("summarizable"), "warming").otherwise("complete"))


def pending(units: DataFrame, *answered: DataFrame, limit: int | None = 20) -> DataFrame:
    """Distinct units without an answer, first met first: norm_hash, ctx_hash, path, line, units.

    `units` counts how many share the answer.  None as limit gives all.
    """
    g = units.where(F.col("norm_hash").isNotNull()).groupBy("norm_hash", "ctx_hash").agg(F.min(F.struct("path", "line")).alias("f"), F.count(F.lit(1)).alias("units"))
    for a in answered:
        g = g.join(a.select("norm_hash", "ctx_hash"), ["norm_hash", "ctx_hash"], "left_anti")
    g = g.select("norm_hash", "ctx_hash", "f.path", "f.line", "units")
    return g if limit is None else g.orderBy("path", "line", "norm_hash", "ctx_hash").limit(limit)


def filled(wanted: DataFrame, summarize: Callable[[str, str], str | None], *, prompt: str, model: str, now: int) -> DataFrame:
    """Rows to store for wanted (norm_hash, ctx_hash, context, source), asked one by one in tasks.

    `summarize` takes context and source and gives a JSON text, or None if it fails; what isn't
    acceptable is dropped here, and stays pending.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"norm_hash": f.norm_hash, "ctx_hash": f.ctx_hash, "json": [summarize(c, s) for c, s in zip(f.context, f.source, strict=True)]})

    rows = wanted.select("norm_hash", "ctx_hash", "context", "source").mapInPandas(ask, "norm_hash string, ctx_hash string, json string").where(acceptable(F.col("json")))
    const = {"prompt": prompt, "model": model, "via": "api", "variant": "body", "level": "unit"}
    return rows.select("norm_hash", "ctx_hash", *[F.lit(v).alias(k) for k, v in const.items()], "json", F.lit(now).cast("long").alias("created_at"))


def context(lang: Column, owner: Column, name: Column, singleton: Column, via: Column, params: Column) -> Column:
    """What is said about a unit besides its source, one fact a line; the text is the key of what is bought for it."""
    ruby, rust = F.when(singleton, "class method").otherwise("instance method"), F.when(singleton, "associated function").otherwise("method")
    named = F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit(" ("), p["kind"], F.lit(")"))), ", ")
    return F.concat(
        F.lit("name: "), name, F.lit("\ndefined on: "), F.when(F.coalesce(owner, F.lit("")) == "", "(top level)").otherwise(owner), F.lit("\nkind: "), F.when(lang == "rust", rust).otherwise(ruby), F.lit("\n"),
        F.coalesce(F.concat(F.lit("generated by: "), via, F.lit("\n")), F.lit("")), F.when(F.size(params) > 0, F.concat(F.lit("parameters: "), named, F.lit("\n"))).otherwise(""),
    )


def decoded_params(text: Column) -> Column:
    """'kind:name;kind:name' as an array of structs; unknown kinds are dropped."""
    kinds = ("req", "opt", "rest", "post", "keyreq", "key", "keyrest", "block", "nokey")
    each = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.struct(F.substring_index(p, ":", 1).alias("kind"), F.regexp_extract(p, r"^[^:]*:(.*)$", 1).alias("name")))
    return F.filter(each, lambda p: p["kind"].isin(*kinds))


def encoded_params(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat(p["kind"], F.lit(":"), p["name"])), ";")


def in_fill_order(wanted: DataFrame, budget: int | None) -> DataFrame:
    """What a fill asks for next: by first place, then by key, as many as the budget has; None is no limit.

    wanted: path, line, norm_hash, ctx_hash, as `pending` gives them.
    """
    asked = wanted.orderBy("path", "line", "norm_hash", "ctx_hash")
    return asked if budget is None else asked.limit(budget)


def usage(answers: DataFrame) -> DataFrame:
    """One row of what answers (input_tokens, output_tokens) cost; nulls cost nothing."""
    return answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")])


def coverage_by_source(units: DataFrame, summaries: DataFrame) -> DataFrame:
    """(model, via, summarizable, summarized, state): how far each source of answers has come with units."""
    u = units.where(F.col("norm_hash").isNotNull()).select("norm_hash", "ctx_hash").groupBy("norm_hash", "ctx_hash").agg(F.count(F.lit(1)).alias("n"))
    total = u.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("summarizable"))
    has = summaries.select("model", "via", "norm_hash", "ctx_hash").distinct().join(u, ["norm_hash", "ctx_hash"], "left").groupBy("model", "via").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("summarized"))
    done, of = F.col("summarized"), F.col("summarizable")
    return has.crossJoin(F.broadcast(total)).select("model", "via", "summarizable", "summarized", F.when(done == 0, "none").when(done < of, "warming").otherwise("complete").alias("state"))
