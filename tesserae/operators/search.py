"""Hybrid search: lexical, semantic and container rankings fused by reciprocal ranks.

Queries come as a DataFrame and are answered together; every ranking is a window within one
query, over the units that score above zero only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import Policy, under
from .sizes import bounded

RRF_K, SUMMARY_WEIGHT, IDENTIFIER_WEIGHT, NON_APP_DISCOUNT, LIMIT = 60.0, 1.0, 0.7, 0.5, 10
TINY = 1.1754943508222875e-38
#: Queries whose vectors are sent to the units at once.
CHUNK = 4096


def rank_by(score: str, *ties: str) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), *ties))


def containers(units: DataFrame) -> DataFrame:
    """(owner, nominee, centroid): owners of two units and more, exactly one of which is public by itself.

    Units: unit, owner, visibility, via (null if written out), vec (null if none).  The
    centroid is the plain mean of the members' vectors, component by component.
    """
    owned = units.where(F.coalesce(F.col("owner"), F.lit("")) != "")
    public = (F.col("visibility") == "public") & F.col("via").isNull()
    heads = owned.groupBy("owner").agg(F.count(F.lit(1)).alias("members"), F.count_if(public).alias("open"), F.min(F.when(public, F.col("unit"))).alias("nominee")).where("members >= 2 and open = 1")
    cells = owned.where(F.col("vec").isNotNull()).join(heads.select("owner"), "owner", "left_semi").select("owner", F.posexplode("vec").alias("dim", "x")).groupBy("owner", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroid = cells.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("centroid"))
    return heads.select("owner", "nominee").join(centroid, "owner")


def word_keys(tokens: Column, min_prefix: int = 2) -> Column:
    """What a unit's tokens can be asked by: (key, weight), each token at 1, else each longer beginning at 0.5."""
    own = F.array_distinct(tokens)
    begins = F.flatten(F.transform(own, lambda t: F.when(F.char_length(t) > min_prefix + 1, F.transform(F.sequence(F.lit(min_prefix + 1), F.char_length(t) - 1), lambda k: F.substr(t, F.lit(1), k))).otherwise(F.array().cast("array<string>"))))
    weighed = lambda keys, w: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(w).alias("weight")))
    return F.concat(weighed(own, 1.0), weighed(F.array_except(begins, own), 0.5))


def lexical(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, unit, lex) where it is above 0: `lexical_score` of each query and unit, by an equi-join on words.

    Units bring each of their tokens and their beginnings once; queries each token as often as
    they repeat it, so only pairs that have a word in common are ever made.
    """
    q = queries.where(F.size("q_tokens") > 0).select("query_id", F.size("q_tokens").alias("of"), F.explode("q_tokens").alias("key")).groupBy("query_id", "of", "key").agg(F.count(F.lit(1)).alias("times"))
    u = units.where(F.size("tokens") > 0).select("unit", F.explode(word_keys(F.col("tokens"))).alias("k")).select("unit", "k.key", "k.weight")
    met = u.join(bounded(q), "key").groupBy("query_id", "unit", "of").agg(F.sum(F.col("weight") * F.col("times")).alias("got"))
    return met.select("query_id", "unit", (F.col("got") / F.col("of")).alias("lex"))


def _cosines(batches: Iterator[pa.RecordBatch], ids: pa.Array, vectors: list[np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    """Cosines of a batch's vectors with each query's; sums run along each vector, so equal vectors tie."""
    norms = [np.sqrt((v * v).sum()) for v in vectors]
    for batch in batches:
        sizes = batch.column("vec").value_lengths().fill_null(0).to_numpy()
        for size in np.unique(sizes[sizes > 0]).tolist():
            part = batch.filter(pa.array(sizes == size))
            x = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            norm = np.sqrt((x * x).sum(axis=1))
            for i, v in enumerate(vectors):
                if len(v) != size or not norms[i] > 0:
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    cos = np.where(norm > 0, (x * v).sum(axis=1) / (norms[i] * norm), 0.0)
                at = np.flatnonzero(cos >= least)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * len(at), ids.type), part.column("unit").take(pa.array(at)), part.column("vec_via").take(pa.array(at)), pa.array(cos[at])], names=["query_id", "unit", "vec_via", "cos"])


def cosines(units: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query_id, unit, vec_via, cos) of units (unit, vec, vec_via) and queries (query_id, q_vec) with cos >= least > 0.

    Units stay where they are; queries go to them, CHUNK at a time.
    """
    asked = queries.where(F.col("q_vec").isNotNull() & (F.size("q_vec") > 0)).select("query_id", "q_vec")
    rows = units.where(F.col("vec").isNotNull()).select("unit", "vec", "vec_via")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, unit {kind['unit']}, vec_via string, cos double"
    chunks = max(1, -(-asked.count() // CHUNK))
    out = None
    for c in range(chunks):
        got = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c).toArrow()
        vectors = [np.array(v, np.float64) for v in got.column("q_vec").to_pylist()]
        found = rows.mapInArrow(partial(_cosines, ids=got.column("query_id").combine_chunks(), vectors=vectors, least=least), schema)
        out = found if out is None else out.unionByName(found)
    return out


def fused(units: DataFrame, queries: DataFrame, *, floor: float = 0.0, scope: str | None = None) -> DataFrame:
    """(query_id, unit, score, lexical, cosine, container_cosine, how) before policy and limit.

    Units: unit (in order of path and line), path, tokens, owner, visibility, via, vec, vec_via.
    Queries: query_id, tokens, vec (null if none).  A unit that only a container nominates counts
    as lexical.
    """
    u = units.where(under(F.col("path"), scope))
    q = queries.select("query_id", F.col("tokens").alias("q_tokens"), F.col("vec").alias("q_vec"))
    none = F.lit(None).cast("double")
    lex = lexical(u, q).withColumn("r", rank_by("lex", "unit"))
    lex = lex.select("query_id", "unit", (F.col("lex") / (RRF_K + F.col("r"))).alias("part"), F.col("lex").alias("lexical"), none.alias("cosine"), none.alias("container_cosine"))
    weight = F.when(F.col("vec_via") == "summary", SUMMARY_WEIGHT).otherwise(IDENTIFIER_WEIGHT)
    sem = cosines(u, q, max(floor, TINY)).withColumn("r", rank_by("cos", "unit"))
    sem = sem.select("query_id", "unit", (weight / (RRF_K + F.col("r"))).alias("part"), none.alias("lexical"), F.col("cos").alias("cosine"), none.alias("container_cosine"))
    heads = containers(u).select(F.col("nominee").alias("unit"), F.col("centroid").alias("vec"), F.lit("").alias("vec_via"))
    con = cosines(heads, q, max(floor, TINY)).withColumn("r", rank_by("cos", "unit"))
    con = con.select("query_id", "unit", (F.col("cos") * IDENTIFIER_WEIGHT / (RRF_K + F.col("r"))).alias("part"), none.alias("lexical"), none.alias("cosine"), F.col("cos").alias("container_cosine"))
    all_ = lex.unionByName(sem).unionByName(con).groupBy("query_id", "unit").agg(
        # the parts in a fixed order, so the sum doesn't depend on how rows were dealt
        (F.coalesce(F.max(F.when(F.col("lexical").isNotNull(), F.col("part"))), F.lit(0.0)) + F.coalesce(F.max(F.when(F.col("cosine").isNotNull(), F.col("part"))), F.lit(0.0)) + F.coalesce(F.max(F.when(F.col("container_cosine").isNotNull(), F.col("part"))), F.lit(0.0))).alias("score"),
        F.max("lexical").alias("lexical"), F.max("cosine").alias("cosine"), F.max("container_cosine").alias("container_cosine"),
    )
    l, s = F.col("lexical").isNotNull(), F.col("cosine").isNotNull()
    return all_.withColumn("how", F.when(l & s, "both").when(s, "semantic").otherwise("lexical"))


def search(units: DataFrame, queries: DataFrame, policy: Policy | None = None, *, floor: float = 0.0, scope: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The best `limit` units of each query, with rank; classes that aren't reported are left out.

    Code outside the app counts half.  Units as in `fused`, with line and lang.
    """
    policy = policy or Policy()
    found = fused(units, queries, floor=floor, scope=scope).join(units.select("unit", "path", "line", "lang", "owner"), "unit")
    found = found.where(policy.reported(policy.of(F.col("path")))).withColumn("class", policy.of_unit(F.col("path"), F.col("lang"), F.col("owner")))
    found = found.withColumn("score", F.when(F.col("class") == "app", F.col("score")).otherwise(F.col("score") * NON_APP_DISCOUNT))
    return found.withColumn("rank", rank_by("score", "path", "line")).where(F.col("rank") <= limit)


def withheld_below(units: DataFrame, queries: DataFrame, floor: float) -> DataFrame:
    """(query_id, withheld): how many units have a cosine above 0 but below the floor; every query has a row."""
    c = cosines(units.withColumn("vec_via", F.lit("")), queries.select("query_id", F.col("vec").alias("q_vec")), TINY)
    n = c.groupBy("query_id").agg(F.count_if(F.col("cos") < floor).alias("withheld"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("withheld", F.lit(0)).alias("withheld"))
