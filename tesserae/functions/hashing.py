"""Content keys: git blob ids, FNV-1a, order-independent fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Fixed values of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a_bytes(data: bytes, seed: int = FNV_OFFSET) -> int:
    """FNV-1a of a byte string, as an unsigned number."""
    h = seed
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_many(texts: list[str | None]) -> np.ndarray:
    """FNV-1a of each text's UTF-8 bytes, unsigned.

    All texts advance together, one byte position at a time, so the loop runs as often as the
    longest text is long and not once per byte.
    """
    raw = [t.encode() if t is not None else b"" for t in texts]
    order = np.argsort([-len(r) for r in raw], kind="stable").astype(np.int64)
    size = np.array([len(raw[i]) for i in order], np.int64)
    buf = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
    start = np.cumsum(size) - size
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))  # those longer than k
        h[:n] = (h[:n] ^ buf[start[:n] + k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return out


@pandas_udf(LongType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """FNV-1a of each text's UTF-8 bytes, as the signed number of the same bits; null for null."""
    return pd.Series(fnv1a_many(list(texts)).view(np.int64), dtype="Int64").where(texts.notna().to_numpy(), pd.NA)


def hex16(h: Column) -> Column:
    """A 64-bit hash as 16 hexadecimal digits; the order of the digits is that of the unsigned numbers."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def blob_oid(data: Column) -> Column:
    """The git object id of a blob with these bytes."""
    raw = data.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


def config_key(kind: str, model: str, dims: int = 256) -> int:
    """The key of an embedding configuration."""
    return fnv1a_bytes(dims.to_bytes(4, "little") + b"\xff" + kind.encode() + b"\xff" + model.encode())


def map_key(path: Column, oid: Column) -> Column:
    """An aggregate over files that changes when a path or its content does, in any order.

    The sum, modulo 2**64, of path hash XOR content hash; decimal sums cannot overflow.
    """
    one = F.xxhash64(path).bitwiseXOR(F.xxhash64(oid))
    total = F.coalesce(F.sum(one.cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)"))
    m = F.pmod(total, F.lit("18446744073709551616").cast("decimal(20,0)"))
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(m >= half, m - half - half).otherwise(m).cast("long")


