"""The health report: 29 rows of checks over Bronze, Silver and Gold, as one DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.plans import gold
from tidewell.table.managed import ManagedTable

LAG_MINUTES, SMALL_MB, MANY_SNAPSHOTS, FEW_FILES = 30, 32, 200, 5


def lag_minutes(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """Minutes from the newest value of ``column`` to ``as_of``; null for an empty table."""
    return df.agg(F.round((F.unix_seconds(as_of) - F.unix_seconds(F.max(column))) / 60.0, 2).alias("lag_min"))


def _row(df: DataFrame, check: str, label: str, status: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(label).alias("label"), status.alias("status"), detail.cast("string").alias("detail"))


def _warn(ok: Column, bad: str = "WARN") -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "OK").otherwise(bad)


def report(bronze: list[ManagedTable], silver: ManagedTable, marts: dict[str, ManagedTable], as_of: Column, lag: float = LAG_MINUTES, small_mb: float = SMALL_MB, many: int = MANY_SNAPSHOTS) -> DataFrame:
    """Freshness, file sizes and snapshots of each table, volume of the day, duplicates, funnel, ratios and cost.

    An empty table is a warning, not a failure; ``failed`` tells whether the report holds a failure.
    """
    tables = [*bronze, silver, *marts.values()]
    rows = [_row(lag_minutes(t.snapshots(), "committed_at", as_of), "freshness", t.name, _warn(F.col("lag_min") <= lag), F.col("lag_min")) for t in bronze]
    rows += [_row(lag_minutes(t.scan(), "updated_at", as_of), "freshness", t.name, _warn(F.col("lag_min") <= lag), F.col("lag_min")) for t in [silver, *marts.values()]]
    for t in tables:
        f = t.files().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg("file_size_in_bytes") / 1048576, 2), F.lit(0.0)).alias("mb"))
        rows.append(_row(f, "files", t.name, _warn(~((F.col("n") > FEW_FILES) & (F.col("mb") < small_mb))), F.concat_ws(" files, MB ", "n", "mb")))
    for t in tables:
        rows.append(_row(t.snapshots().agg(F.count(F.lit(1)).alias("n")), "snapshots", t.name, _warn(F.col("n") <= many), F.col("n")))
    s, campaigns = silver.scan(), next(iter(marts.values())).scan()
    rows.append(_row(volume(s, as_of), "volume", silver.name, _warn(F.col("today") > 0), F.concat_ws("/", "today", "total")))
    rows.append(_row(s.agg((F.count(F.lit(1)) - F.count_distinct("event_id")).alias("n")), "duplicates", silver.name, _warn(F.col("n") == 0, "FAIL"), F.col("n")))
    for check, bad in (("funnel", gold.funnel_violations(campaigns)), ("ratio", gold.ratio_violations(campaigns))):
        rows.append(_row(bad.agg(F.count(F.lit(1)).alias("n")), check, next(iter(marts)), _warn(F.col("n") == 0, "FAIL"), F.col("n")))
    rows.append(_row(gold.cost_consistency(campaigns, s), "cost", next(iter(marts)), _warn(F.col("diff") < 0.01), F.col("diff")))
    return reduce(DataFrame.unionByName, rows)


def volume(silver: DataFrame, as_of: Column) -> DataFrame:
    """Rows written on the day of ``as_of``, and all rows."""
    return silver.agg(F.count_if(F.col("updated_at") >= F.date_trunc("day", as_of)).alias("today"), F.count(F.lit(1)).alias("total"))


def failed(report_: DataFrame) -> bool:
    """The gate: whether a check failed. Warnings pass."""
    return not report_.where(F.col("status") == "FAIL").isEmpty()
