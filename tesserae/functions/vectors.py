"""Vector expressions and the feature-hashing embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from .hashing import fnv1a_bytes, fnv1a_many
from .text import tokens

NATIVE_DIMS, DIMS = 384, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different lengths, empty or zero vectors, and nulls."""
    d = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (d > 0), dot(a, b) / d), F.lit(0.0))


def shortened(a: Column, dims: int = DIMS) -> Column:
    """The first `dims` components at unit length; a zero vector stays as it is. Shorter vectors are an error."""
    cut = F.transform(F.slice(a, 1, dims), lambda x: x.cast("double"))
    ok = F.when(F.size(a) >= dims, cut).otherwise(F.raise_error(F.lit(f"a vector has fewer than {dims} components")))
    n = norm(F.slice(a, 1, dims))
    return F.when(n > 0, F.transform(ok, lambda x: x / n)).otherwise(ok)


def embed_text(text: str) -> np.ndarray:
    """Signed feature hashing of a text's tokens: cell by the hash modulo 256, sign by its bit 32."""
    import regex

    out = np.zeros(NATIVE_DIMS, np.float32)
    for t in regex.findall(r"[\p{L}\p{N}]+", text.lower()):
        h = fnv1a_bytes(t.encode())
        out[h % DIMS] += 1.0 if h >> 32 & 1 == 0 else -1.0
    return out


@pandas_udf(ArrayType(FloatType()))
def hash_embed(texts: pd.Series) -> pd.Series:
    """Each text's embedding by feature hashing, as `embed_text`; null for null.

    The distinct tokens of a batch are hashed together, and all texts are summed at once.
    """
    import regex

    found = [regex.findall(r"[\p{L}\p{N}]+", t.lower()) if t is not None else [] for t in texts]
    own, back = np.unique(np.array([t for f in found for t in f], object), return_inverse=True) if any(found) else (np.zeros(0, object), np.zeros(0, np.int64))
    h = fnv1a_many(list(own))
    out = np.zeros((len(found), NATIVE_DIMS), np.float32)
    text = np.repeat(np.arange(len(found)), [len(f) for f in found])
    np.add.at(out, (text, (h % np.uint64(DIMS)).astype(np.int64)[back]), np.where(h >> np.uint64(32) & np.uint64(1), -1.0, 1.0).astype(np.float32)[back])
    return pd.Series([None if t is None else v for t, v in zip(texts, out, strict=True)])


def hash_embed_native(df: DataFrame, key: str, text: Column, dims: int = DIMS) -> DataFrame:
    """(key, dim, value): feature hashing in DataFrame functions alone, on md5 instead of FNV.

    Long format: a text has a row for each cell that isn't zero, so nothing is as wide as the
    vocabulary and counts are combined before the shuffle.
    """
    t = df.select(key, F.explode(tokens(text)).alias("t"))
    h = F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(F.md5("t"), 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return t.select(key, (h % dims).cast("int").alias("dim"), sign.alias("s")).groupBy(key, "dim").agg(F.sum("s").cast("double").alias("value")).where("value != 0")


def mean_pool(values: Column, mask: Column) -> Column:
    """The mean of the vectors that the mask marks; `values` holds one vector per place."""
    pairs = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda p: p["m"] != 0)
    width = F.size(values[0])
    total = F.aggregate(pairs, F.array_repeat(F.lit(0.0), width), lambda acc, p: F.zip_with(acc, p["v"], lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(pairs), F.lit(1)))


#: Texts per second and thread, by kind of embedder, for the admission check.
RATES = {"onnx": 37.0, "hash": 1_060_000.0}
#: Cosine below which an answer is no answer, by kind.
FLOORS = {"onnx": 0.40}


def projected_seconds(kind: str, n_texts: int, threads: int) -> float:
    return n_texts / (RATES.get(kind, RATES["onnx"]) * max(threads, 1))


def afford(kind: str, n_texts: int, threads: int, budget: float | None = 300.0) -> None:
    """Refuse to embed what would take longer than the budget; None or 0 is no limit."""
    need = projected_seconds(kind, n_texts, threads)
    if budget and need > budget:
        raise RuntimeError(f"embedding {n_texts} texts would take about {need:.0f} s, above the budget of {budget:.0f} s; embed in advance or narrow the scope")
