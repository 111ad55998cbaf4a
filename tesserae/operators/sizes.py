"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are sent to every executor at most.
ROWS = 100_000


def bounded(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df with a broadcast hint if it has few enough rows; as it is otherwise, for a distributed join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
