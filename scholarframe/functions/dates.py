"""Dates known to the year, the month or the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(s: Column) -> Column:
    """``day``, ``month`` or ``year``; null for other forms."""
    return F.when(s.rlike("^\\d{4}-\\d{2}-\\d{2}$"), "day").when(s.rlike("^\\d{4}-\\d{2}$"), "month").when(s.rlike("^\\d{4}$"), "year")


def first_day(s: Column) -> Column:
    """The earliest day a partial date can mean."""
    return F.try_to_date(F.when(precision(s) == "year", F.concat(s, F.lit("-01-01"))).when(precision(s) == "month", F.concat(s, F.lit("-01"))).otherwise(s), "yyyy-MM-dd")


def last_day(s: Column) -> Column:
    """The latest day a partial date can mean."""
    start = first_day(s)
    return F.when(precision(s) == "year", F.make_date(F.year(start), F.lit(12), F.lit(31))).when(precision(s) == "month", F.last_day(start)).otherwise(start)
