"""Answers for people and programs: one serialisation on every surface."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

HIT, MISS, ERROR = 0, 1, 2


def ndjson(df: DataFrame) -> Iterator[str]:
    """One JSON object a row, streamed partition by partition."""
    return df.toJSON().toLocalIterator()


def pretty(df: DataFrame) -> str:
    """An indented JSON array; for results that are meant to be read."""
    return json.dumps([json.loads(r) for r in ndjson(df)], indent=2, ensure_ascii=False)


def write(df: DataFrame, path: str) -> None:
    """NDJSON files in a folder, written by the executors."""
    df.write.mode("overwrite").json(path)


def exit_code(df: DataFrame) -> int:
    """0 if there is an answer, 1 if there is none."""
    return HIT if df.limit(1).count() else MISS
