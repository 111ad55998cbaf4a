"""Dates and spans as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(unix: Column) -> Column:
    """The UTC day of a time in seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(unix / 86400).cast("int")).cast("string")


def span(seconds: Column) -> Column:
    """Whole years of 365 days, else months of 30, else days, else 'under a day'."""
    days = F.floor(seconds / 86400).cast("long")

    def say(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))

    years, months = F.floor(days / 365), F.floor(days / 30)
    return F.when(days >= 365, say(years, "year")).when(days >= 30, say(months, "month")).when(days >= 1, say(days, "day")).otherwise("under a day")
