"""Exact top-k search by inner product, with pivot-table elimination.

Every row's distances to a fixed set of many pivot vectors are computed once and kept with the
row.  For a query q and a candidate x the triangle inequality gives, for each pivot p,
|d(q,p) - d(x,p)| <= d(q,x); the largest of these bounds the distance from below and, as
2<q,x> = |q|^2 + |x|^2 - d(q,x)^2, the score from above.  Candidates are evaluated in the
order of their bounds, until the next bound falls below the k-th score found.

Rows are dealt by their nearest pivot into blocks and stay there.  A block knows the least and
greatest distance of its rows to each pivot, which bounds all of its scores at once.  Queries go
to the blocks, a chunk of bounded size at a time; each brings a score to beat, its k-th best
among a bounded sample of rows, so that blocks and candidates below it are passed over from the
start, and a task's later blocks know what its earlier ones found.  Only results are shuffled:
what is sent grows with the rows and with the queries, never with their product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import kept, scratch

#: Pivots per vector length.
PIVOTS = 128
#: Rows per vector length, about, among which a query's first scores to beat are found.
SEEDS = 4096
#: Rows in a block.
BLOCK = 8192
#: Queries that are sent out at once: 1 KB each for 64 components.
CHUNK = 32_768
#: Candidates evaluated between two looks at the bounds, at first; the number doubles up to the last.
STRIDE, WIDEST = 64, 1024
LONG = (1 << 63) - 1


def whole(vec: Column, scale: int) -> Column:
    """Each component as floor(scale * component), in 64 bits (larger values saturate)."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vec: Column) -> Column:
    """Neither null nor holding a null or a value that isn't finite."""
    x_ok = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(x_ok(x), F.lit(False)))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: the distance of each row to each pivot, rounded to single precision."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def _with_table(batches: Iterator[pa.RecordBatch], pivots: Broadcast) -> Iterator[pa.RecordBatch]:
    """Add the pivot table, and the nearest pivot."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            d = distances(_matrix(part.column("vec"), int(dim), np.float64), pivots.value[int(dim)])
            table = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("id", "dim", "vec")] + [pa.array(d.argmin(axis=1).astype(np.int32)), table], names=["id", "dim", "vec", "cell", "table"])


def _scores(rows: np.ndarray, query: np.ndarray, exact_in_double: bool) -> np.ndarray:
    if exact_in_double:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    sums = rows.astype(object) @ query.astype(object)
    return np.array([max(-LONG - 1, min(LONG, int(s))) for s in np.atleast_1d(sums)], np.int64)


def slack(square: np.ndarray | float) -> np.ndarray | float:
    """What rounding may take from a bound on scores of vectors with these squares, and more."""
    return 1e-5 * square + 1


def search_block(
    q_id: np.ndarray, q: np.ndarray, q_table: np.ndarray, x_id: np.ndarray, x: np.ndarray, x_table: np.ndarray, k: int, least: np.ndarray | None = None
) -> tuple[list[int], list[int], list[int], int]:
    """The k best rows of a block for each query: query ids, row ids, scores, and how many were evaluated.

    Rows that score less than the query's `least` may be left out.
    """
    least = np.full(len(q_id), -np.inf) if least is None else least
    top = [float(np.abs(m.astype(np.float64)).max()) if m.size else 0.0 for m in (q, x)]
    small = top[0] * top[1] * max(x.shape[1], 1) < 1 << 52
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    q2, x2 = (qf**2).sum(axis=1), (xf**2).sum(axis=1)
    xs = xf if small else x
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    seen = 0
    if not len(x_id):
        return *out, seen
    by_pivot = np.ascontiguousarray(x_table.T)
    low, high = by_pivot.min(axis=1), by_pivot.max(axis=1)
    far = np.maximum(low - q_table, q_table - high).max(axis=1, initial=0).astype(np.float64)
    reach = (q2 + x2.max() - far * far) / 2 + slack(q2 + x2.max())
    for i in np.flatnonzero(reach >= least):
        far = np.abs(by_pivot - q_table[i][:, None]).max(axis=0).astype(np.float64)
        bound = (q2[i] + x2 - far * far) / 2 + slack(q2[i] + x2)
        order = np.flatnonzero((bound >= least[i]) & (x_id != q_id[i]))
        order = order[np.argsort(-bound[order], kind="stable")]
        best: list[tuple[int, int]] = []
        at, stride = 0, STRIDE
        while at < len(order) and not (len(best) == k and bound[order[at]] < -best[-1][0]):
            part = order[at : at + stride]
            at, stride = at + stride, min(2 * stride, WIDEST)
            score = _scores(xs[part], q[i], small)
            seen += len(part)
            fit = score >= max(least[i], -best[-1][0] if len(best) == k else -np.inf)
            part, score = part[fit], score[fit]
            if len(part):
                best = sorted(best + [(-int(s), int(c)) for s, c in zip(score, x_id[part], strict=True)])[:k]
        out[0].extend([int(q_id[i])] * len(best))
        out[1].extend(c for _, c in best)
        out[2].extend(-s for s, _ in best)
    return *out, seen


def to_beat(q_id: np.ndarray, q: np.ndarray, s_id: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among some rows, its own aside; -inf where there are too few or it isn't exact."""
    out = np.full(len(q_id), -np.inf)
    qf, sf = q.astype(np.float64), s.astype(np.float64)
    if len(s_id) <= k or (np.abs(qf).max(initial=0) * np.abs(sf).max(initial=0) * max(q.shape[1], 1)) >= 1 << 52:
        return out
    for at in range(0, len(q_id), 1024):
        scores = qf[at : at + 1024] @ sf.T
        scores[q_id[at : at + 1024][:, None] == s_id] = -np.inf
        out[at : at + 1024] = np.partition(scores, len(s_id) - k, axis=1)[:, len(s_id) - k]
    return out


class Queries:
    """A chunk of queries, by vector length: ids, vectors, pivot tables and scores to beat."""

    def __init__(self, table: pa.Table, pivots: dict[int, np.ndarray], seeds: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> None:
        self.parts = {}
        dims = table.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = table.filter(pa.array(dims == dim))
            ids, q = part.column("id").to_numpy(), _matrix(part.column("vec"), dim, np.int64)
            self.parts[dim] = ids, q, distances(q.astype(np.float64), pivots[dim]), to_beat(ids, q, *seeds[dim], k)


def _search(batches: Iterator[pa.RecordBatch], queries: Broadcast, k: int, block: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of a task for each query, and one row (without ids) of how many were evaluated."""
    found: dict[int, list[np.ndarray]] = {}
    least = {dim: part[3].copy() for dim, part in queries.value.parts.items()}
    held: list[pa.RecordBatch] = []
    seen = every = 0

    def flush() -> None:
        nonlocal seen, every
        if not held:
            return
        x = pa.Table.from_batches(held)
        held.clear()
        dim = x.column("dim")[0].as_py()
        if dim not in least:
            return
        ids, q, q_table, _ = queries.value.parts[dim]
        x_table = _matrix(x.column("table"), q_table.shape[1], np.float32)
        *got, n = search_block(ids, q, q_table, x.column("id").to_numpy(), _matrix(x.column("vec"), dim, np.int64), x_table, k, least[dim])
        seen, every = seen + n, every + len(ids) * x.num_rows
        new = np.array(got, np.int64).reshape(3, -1)
        best = np.concatenate((found.get(dim, new[:, :0]), new), axis=1)
        best = best[:, np.lexsort((best[1], ~best[2], best[0]))]
        begin = np.ones(best.shape[1], bool)
        begin[1:] = best[0, 1:] != best[0, :-1]
        place = np.arange(best.shape[1]) - np.maximum.accumulate(np.where(begin, np.arange(best.shape[1]), 0))
        found[dim] = best[:, place < k]
        kth = best[:, place == k - 1]
        at = np.argsort(ids)
        at = at[np.searchsorted(ids[at], kth[0])]
        least[dim][at] = np.maximum(least[dim][at], kth[2])

    for batch in batches:
        dims = batch.column("dim").to_numpy()
        cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            while lo < hi:
                if held and (held[0].column("dim")[0].as_py() != dims[lo] or sum(h.num_rows for h in held) >= block):
                    flush()
                take = min(hi - lo, block - sum(h.num_rows for h in held))
                held.append(batch.slice(lo, take))
                lo += take
    flush()
    best = np.concatenate([np.zeros((3, 0), np.int64), *found.values()], axis=1)
    one = lambda row, last: pa.array([*row.tolist(), last], pa.int64())
    n = best.shape[1]
    yield pa.RecordBatch.from_arrays([one(best[0], None), one(best[1], None), one(best[2], None), one(np.zeros(n, np.int64), seen), one(np.zeros(n, np.int64), every)], names=["query_id", "vec_id", "score", "seen", "every"])


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, pivots: int = PIVOTS, with_share: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows of highest inner product.

    Components become floor(scale * x) and scores are integers, exact; a score beyond 64
    bits saturates.  Ties go to the smaller id.  A row is no candidate for queries of its own
    id, and only vectors of one length are compared.  Null vectors, vectors with null or
    non-finite components, and null ids take no part.  Repeated rows are candidates each; a
    query id that repeats asks once, with the least of its vectors.  An empty table, or one
    without queries, gives an empty one.  Other columns are ignored.  `with_share` adds
    `evaluated`, the share of all pairs of queries and rows that bounds did not eliminate.
    """
    with scratch(vectors.sparkSession):
        return kept(_top_k(vectors, is_query, id_col, vec_col, k, scale, pivots, with_share), "topk", lasting=True)


def _sampled(rows: DataFrame, spark: SparkSession, n_pivots: int) -> tuple[dict[int, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """For each vector length its pivots, and a sample of its rows (ids, vectors), the same on every run.

    The sample is drawn by a hash, SEEDS rows or about as many, and equal rows count once.
    """
    sizes = rows.groupBy("dim").count().collect()
    share = spark.createDataFrame([(r["dim"], min(1.0, SEEDS / r["count"])) for r in sizes], "dim int, share double")
    draw = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(share), "dim").where(draw < F.col("share")).select("dim", "id", "vec", draw.alias("draw")).distinct().toArrow().sort_by([("dim", "ascending"), ("draw", "ascending"), ("id", "ascending")])
    pivots, seeds = {}, {}
    dims = chosen.column("dim").to_numpy()
    for r in sizes:
        part = chosen.filter(pa.array(dims == r["dim"]))
        x = _matrix(part.column("vec"), r["dim"], np.int64)
        seeds[r["dim"]] = part.column("id").to_numpy(), x
        pivots[r["dim"]] = x[:n_pivots].astype(np.float64) if len(x) else np.zeros((1, r["dim"]))
    return pivots, seeds


def _top_k(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str, k: int, scale: int, n_pivots: int, with_share: bool) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("raw")))
    rows = rows.select("id", "asks", F.size("raw").alias("dim"), whole(F.col("raw"), scale).alias("vec"))
    asked = rows.where("asks").groupBy("id", "dim").agg(F.min("vec").alias("vec")).groupBy("id").agg(F.min_by(F.struct("dim", "vec"), "dim").alias("q")).select("id", "q.dim", "q.vec")
    asked = kept(asked, "queries")
    n = asked.count()
    result = "query_id long, rank int, vec_id long, score long" + ", evaluated double" * with_share
    if not n:
        return spark.createDataFrame([], result)
    pivots, seeds = _sampled(rows, spark, n_pivots)
    sent = spark.sparkContext.broadcast(pivots)
    table = rows.select("id", "dim", "vec").mapInArrow(partial(_with_table, pivots=sent), "id long, dim int, vec array<long>, cell int, table array<float>")
    blocks = max(1, -(-rows.count() // BLOCK))
    # by nearest pivot; equal vectors are spread by their ids
    order = ["dim", "cell", F.xxhash64("id", F.lit(1))]
    table = kept(table.repartitionByRange(blocks, *order).sortWithinPartitions(*order), "pivots")
    chunks = -(-n // CHUNK)
    best = None
    for c in range(chunks):
        chunk = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).toArrow()
        queries = spark.sparkContext.broadcast(Queries(chunk, pivots, seeds, k))
        got = kept(table.mapInArrow(partial(_search, queries=queries, k=k, block=BLOCK), "query_id long, vec_id long, score long, seen long, every long"), "best")
        queries.unpersist()
        best = got if best is None else best.unionByName(got)
    found = best.where("query_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    out = found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    if with_share:
        share = best.where("query_id is null").agg(F.sum("seen") / F.sum("every")).first()[0]
        out = out.withColumn("evaluated", F.lit(share))
    return out
