"""Funnel indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_of(event_type: str) -> Column:
    """Rows of one type; 0, never null, for a group without any."""
    return F.count_if(F.col("event_type") == event_type)


def click_cost() -> Column:
    """Cost of the clicks: 0.0 without clicks, null only if every addend is a click's null cost."""
    return F.sum(F.when(F.col("event_type") == "click", F.col("cost")).otherwise(F.lit(0.0)))


def ratio(num: Column | str, den: Column | str, digits: int = 6) -> Column:
    """Rounded quotient; null for a zero or null denominator."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (num, den))
    return F.round(F.try_divide(n, F.nullif(d, F.lit(0))), digits)


def ratio_or_zero(num: Column | str, den: Column | str, digits: int = 6) -> Column:
    """As ``ratio``, with 0.0 for a zero denominator, as reports show it."""
    return F.coalesce(ratio(num, den, digits), F.lit(0.0))
