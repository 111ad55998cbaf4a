"""All registered queries: each takes (spark, folder of tables) and returns a DataFrame."""

from . import documents, scored, tables, tiers  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
