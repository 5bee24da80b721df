"""Silver to Gold: the three marts, their incremental refresh and the serving queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import display
from tidewell.functions.kpi import click_cost, count_of, ratio, ratio_or_zero
from tidewell.schemas import REVENUE_PER_CONVERSION

COUNTS = {"requests": "request", "impressions": "impression", "clicks": "click", "conversions": "conversion"}


def _counts() -> list[Column]:
    return [count_of(t).alias(n) for n, t in COUNTS.items()]


def _ratios() -> list[Column]:
    return [ratio("impressions", "requests").alias("fill_rate"), ratio("clicks", "impressions").alias("ctr"), ratio("conversions", "clicks").alias("cvr")]


def campaign_daily(silver: DataFrame, revenue: float = REVENUE_PER_CONVERSION) -> DataFrame:
    """One row for each campaign and day. CPA and ROAS use the cost as rounded."""
    g = silver.groupBy("campaign_id", "event_date").agg(*_counts(), F.round(click_cost(), 6).alias("cost"))
    return g.select("campaign_id", "event_date", *COUNTS, *_ratios(), "cost", ratio("cost", "conversions").alias("cpa"), ratio(F.col("conversions") * F.lit(revenue), "cost").alias("roas"))


def banner_daily(silver: DataFrame) -> DataFrame:
    """One row for each banner and day, with the hour of most impressions (the earliest of equals, null without any).

    One aggregation by hour feeds both, instead of a second pass and a join: rows with null banner keep a null peak, as
    null keys match nothing.
    """
    h = silver.groupBy("banner_id", "event_date", F.hour("event_timestamp").alias("hour")).agg(
        count_of("impression").alias("impressions"), count_of("click").alias("clicks"), click_cost().alias("cost")
    )
    peak = F.max_by("hour", F.when(F.col("impressions") > 0, F.struct(F.col("impressions").alias("n"), (-F.col("hour")).alias("h"))))
    g = h.groupBy("banner_id", "event_date").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.round(F.sum("cost"), 6).alias("cost"), peak.alias("peak_hour"))
    return g.select("banner_id", "event_date", "impressions", "clicks", ratio("clicks", "impressions").alias("ctr"), F.when(F.col("banner_id").isNotNull(), F.col("peak_hour")).alias("peak_hour"), "cost")


def hourly_funnel(silver: DataFrame) -> DataFrame:
    g = silver.groupBy("event_date", F.hour("event_timestamp").alias("hour")).agg(*_counts())
    return g.select("event_date", "hour", *COUNTS, *_ratios())


def affected_dates(silver: DataFrame, as_of: Column, lookback_days: int = 3) -> DataFrame:
    """Days with rows updated within the lookback."""
    return silver.where(F.col("updated_at") >= as_of - F.expr(f"INTERVAL {int(lookback_days)} DAYS")).select("event_date").distinct()


def refresh(silver: DataFrame, marts: dict, as_of: Column, lookback_days: int | None = 3) -> list:
    """Recomputes the affected days (all for None) of each mart and replaces just their partitions.

    ``marts`` maps a function of this module to the managed table it feeds. The list of days is the one driver-side step;
    it makes partition pruning static.
    """
    part = silver
    days: list = []
    if lookback_days is not None:
        days = [r["event_date"] for r in affected_dates(silver, as_of, lookback_days).collect()]
        if not days:
            return []
        part = silver.where(F.col("event_date").isin(days))
    for make, table in marts.items():
        table.overwrite_partitions(make(part).withColumn("updated_at", as_of))
    return days


def refresh_changed(silver_table, since: int, marts: dict, as_of: Column) -> list:
    """Recomputes the days whose partitions of the Silver table changed after snapshot ``since``.

    Unlike ``refresh`` this also sees days that only lost rows, as when an update moves an event to another day; days left
    without rows are emptied in the marts.
    """
    days = sorted({p["event_date"] for p in silver_table.changed_partitions(since)} - {None})
    if not days:
        return []
    part = silver_table.scan(where=lambda p: p["event_date"] in days).where(F.col("event_date").isin([F.lit(d).cast("date") for d in days]))
    there = {str(r["event_date"]) for r in part.select("event_date").distinct().collect()}
    for make, table in marts.items():
        if there:
            table.overwrite_partitions(make(part).withColumn("updated_at", as_of))
        for gone in set(days) - there:
            table.delete_where(F.col("event_date") == F.lit(gone).cast("date"))
    return days


# --- serving ---------------------------------------------------------------------------------------------------------


def kpi_totals(campaigns: DataFrame, revenue: float = REVENUE_PER_CONVERSION) -> DataFrame:
    s = campaigns.agg(*(F.sum(c).alias(c) for c in ("impressions", "clicks", "conversions")), F.sum("cost").alias("c"))
    return s.select(
        "impressions", "clicks", "conversions", F.round("c", 2).alias("cost"), ratio("clicks", "impressions", 4).alias("ctr"), ratio("conversions", "clicks", 4).alias("cvr"),
        ratio(F.col("conversions") * F.lit(revenue), "c", 2).alias("roas"),
    )


def top_campaigns(campaigns: DataFrame, n: int = 20) -> DataFrame:
    cols = ["campaign_id", "event_date", "impressions", "clicks", "conversions", "ctr", "cvr", "cost", "cpa", "roas"]
    return campaigns.select(*cols).orderBy(F.desc_nulls_last("cost"), "campaign_id", "event_date").limit(n)


def top_banners(banners: DataFrame, n: int = 20, least_impressions: int = 100) -> DataFrame:
    b = banners.where(F.col("impressions") >= least_impressions)
    return b.select("banner_id", "event_date", "impressions", "clicks", "ctr", "peak_hour", "cost").orderBy(F.desc_nulls_last("ctr"), F.desc("impressions"), "banner_id", "event_date").limit(n)


def funnel_violations(campaigns: DataFrame) -> DataFrame:
    c = F.col
    bad = (c("impressions") > c("requests")) | (c("clicks") > c("impressions")) | (c("conversions") > c("clicks"))
    return campaigns.where(bad).select("campaign_id", "event_date", "requests", "impressions", "clicks", "conversions")


def ratio_violations(campaigns: DataFrame) -> DataFrame:
    """Rows with a ratio outside 0 to 1; null ratios pass."""
    bad = ~F.col("fill_rate").between(0, 1) | ~F.col("ctr").between(0, 1) | ~F.col("cvr").between(0, 1)
    return campaigns.where(bad).select("campaign_id", "event_date", "fill_rate", "ctr", "cvr")


def cost_consistency(campaigns: DataFrame, silver: DataFrame) -> DataFrame:
    """Gold cost beside the cost of Silver's clicks, and their difference."""
    g = campaigns.agg(F.coalesce(F.round(F.sum("cost"), 2), F.lit(0.0)).alias("gold_cost"), F.lit(0.0).alias("silver_click_cost"))
    s = silver.where(F.col("event_type") == "click").agg(F.lit(0.0).alias("gold_cost"), F.coalesce(F.round(F.sum("cost"), 2), F.lit(0.0)).alias("silver_click_cost"))
    both = g.unionByName(s).agg(F.sum("gold_cost").alias("gold_cost"), F.sum("silver_click_cost").alias("silver_click_cost"))
    return both.withColumn("diff", F.round(F.abs(F.col("gold_cost") - F.col("silver_click_cost")), 2))


# --- report ----------------------------------------------------------------------------------------------------------


def daily_rollup(campaigns: DataFrame, as_of: Column, lookback_days: int = 35) -> DataFrame:
    """Sums by day of the last days; nulls count as 0. There is no upper bound."""
    c = campaigns.where(F.col("event_date") >= F.date_sub(F.to_date(as_of), lookback_days))
    return c.groupBy("event_date").agg(
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTS), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost")
    )


def daily_kpis(rollup: DataFrame, revenue: float = REVENUE_PER_CONVERSION) -> DataFrame:
    return rollup.select(
        "event_date", "impressions", "clicks", "conversions", "cost", ratio_or_zero("clicks", "impressions").alias("ctr"), ratio_or_zero("conversions", "clicks").alias("cvr"),
        ratio_or_zero(F.col("conversions") * F.lit(revenue), "cost").alias("roas"),
    )


def wow_mom(kpis: DataFrame, day: Column, week: int = 7, month: int = 28) -> DataFrame:
    """``(metric, value, wow_pct, mom_pct)`` of one day against the same weekday one and four weeks before.

    The change is null if the earlier day is missing or its value is 0.
    """
    metrics = ["impressions", "clicks", "conversions", "cost", "ctr", "cvr", "roas"]
    which = F.when(F.col("event_date") == day, 0).when(F.col("event_date") == F.date_sub(day, week), 1).when(F.col("event_date") == F.date_sub(day, month), 2)
    long = kpis.withColumn("w", which).where(F.col("w").isNotNull()).select("w", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x"))
    p = long.groupBy("x.metric").agg(*(F.max(F.when(F.col("w") == k, F.col("x.v"))).alias(n) for k, n in enumerate(("value", "wow", "mom"))))
    change = lambda n: F.round(F.try_divide(F.col("value") - F.col(n), F.nullif(F.col(n), F.lit(0.0))) * 100, 4)
    return p.where(F.col("value").isNotNull()).select("metric", F.round("value", 6).alias("value"), change("wow").alias("wow_pct"), change("mom").alias("mom_pct"))


def report_lines(compared: DataFrame) -> DataFrame:
    """The rows of ``wow_mom`` as a report shows them: ``(metric, shown, wow, mom)``."""
    m, v = F.col("metric"), F.col("value")
    shown = F.when(m == "cost", display.money(v)).when(m.isin("ctr", "cvr"), display.percent(v)).when(m == "roas", F.format_string("%.2fx", v)).otherwise(display.short_number(v))
    return compared.select("metric", shown.alias("shown"), display.change(F.col("wow_pct")).alias("wow"), display.change(F.col("mom_pct")).alias("mom"))


def report_day(campaigns: DataFrame, as_of: Column, asked: str | None = None) -> DataFrame:
    """One row ``day``: the day asked for, else the day before ``as_of``; the latest day there is if that has no rows."""
    want = F.lit(asked).cast("date") if asked else F.date_sub(F.to_date(as_of), 1)
    return campaigns.agg(F.when(F.max((F.col("event_date") == want).cast("int")) == 1, want).otherwise(F.max("event_date")).alias("day"))


def recent_days(kpis: DataFrame, day: Column, n: int) -> DataFrame:
    """The last ``n`` days there are, up to ``day``."""
    return kpis.where(F.col("event_date") <= day).orderBy(F.desc("event_date")).limit(n)



def trend_chart(kpis: DataFrame, metric: str, width: int = 720, height: int = 240) -> str:
    """The days of ``recent_days`` (at most a month, a row each) as an SVG line of one metric. Nulls leave a gap."""
    rows = sorted(((r["event_date"], r[metric]) for r in kpis.select("event_date", metric).collect()), key=lambda r: str(r[0]))
    known = [float(v) for _, v in rows if v is not None]
    top, step = max(known, default=0) or 1.0, width / max(1, len(rows) - 1)
    lines: list[list[str]] = [[]]
    for k, (_, v) in enumerate(rows):
        if v is None:
            lines.append([])
        else:
            lines[-1].append(f"{k * step:.1f},{height - float(v) / top * height:.1f}")
    drawn = "".join(f'<polyline fill="none" stroke="#2a6fb0" stroke-width="2" points="{" ".join(p)}"/>' for p in lines if p)
    ends = f"{rows[0][0]} to {rows[-1][0]}" if rows else "no days"
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 -20 {width} {height + 40}"><text x="0" y="-6" font-size="13">{metric}, {ends}</text>{drawn}</svg>'
