"""Figures as reports show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_number(c: Column) -> Column:
    """1.50M, 2.3k or 42."""
    x = c.cast("double")
    return F.when(F.abs(x) >= 1e6, F.format_string("%.2fM", x / 1e6)).when(F.abs(x) >= 1e3, F.format_string("%.1fk", x / 1e3)).otherwise(F.format_string("%.0f", x))


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c.cast("double"), 0))


def percent(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", c.cast("double") * 100)


def change(c: Column) -> Column:
    """A change in per cent with an arrow; n/a for none."""
    x = c.cast("double")
    arrow = F.when(x >= 0, "▲").otherwise("▼")
    return F.when(x.isNull(), "n/a").otherwise(F.concat(arrow, F.format_string("%+.1f%%", x)))


def padded(c: Column, width: int) -> Column:
    """Filled up on the left to a display width, of which wide East Asian letters take two."""
    wide = F.length(F.regexp_replace(c, r"[^\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}]", ""))
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(c) - wide)), c)
