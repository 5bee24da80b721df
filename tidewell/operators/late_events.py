"""Per-period aggregates by event time, corrected as late records arrive, with a cut-off for lateness.

Each source has a low watermark of its own: the arrivals it has shown so far, less ``lateness``. Its first arrival past a
period's bound (the period's end and ``lateness``) is its punctuation for the period: it declares the period over for
the source, and itself and what the source brings for that period from then on is diverted. Since a record is an arrival
of its own source, that diverts exactly the records beyond the bound, whatever the other sources do. A period closes for
all, and its counts are final, when every source has punctuated it; a source silent for ``idle`` after the bound counts
as idle and holds nothing back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.ids import bare_id, message_id
from tidewell.session import materialise

PERIOD = 3600
LATENESS = 24 * 3600
IDLE = 6 * 3600
#: Punctuations (one for each source and period) up to which they are sent to all tasks: about 40 MB.
BROADCAST_MARKS = 500_000


def arrivals(events: DataFrame, messages: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the row that stands for each event, ``event_id`` (bare) and its ``arrival``.

    Arrival is the earliest kafka_timestamp of the event's messages if it has any, otherwise the earliest updated_at of
    its rows. Rows and messages meet in one aggregation by identifier, combined before its exchange, instead of a join.
    Messages without a row here, and rows that lack both an identifier and updated_at, have no event to count: the
    former are left out, the latter come out with a null arrival.
    """
    keep = [c for c in columns if c not in ("event_id", "updated_at")]
    ident = bare_id("event_id")
    row = F.struct(F.col("updated_at").isNull().alias("missing"), "updated_at", *keep)
    rows = events.where(ident.isNotNull()).select(ident.alias("event_id"), row.alias("r"), F.lit(None).cast("timestamp").alias("sent"))
    sent = messages.select(message_id("value").alias("event_id"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"), F.col("kafka_timestamp").alias("sent"))
    sent = sent.where(F.col("event_id").isNotNull())
    both = rows.unionByName(sent).groupBy("event_id").agg(F.min("r").alias("r"), F.min("sent").alias("sent")).where(F.col("r").isNotNull())
    known = both.select("event_id", *(F.col(f"r.{c}").alias(c) for c in keep), F.coalesce("sent", "r.updated_at").alias("arrival"))
    alone = events.where(ident.isNull()).select(F.lit(None).cast("string").alias("event_id"), *keep, F.col("updated_at").alias("arrival"))
    return known.unionByName(alone)


def seconds(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def periods(events: DataFrame, ts: str = "event_timestamp", arrival: str = "arrival", source: str = "source", period: int = PERIOD) -> DataFrame:
    """Events with ``period_start`` (epoch seconds), ``delay_us`` of the arrival past the period's end, and ``__src``.

    Events without time have no period and are left out. One without arrival is taken as on time, one without source as
    of a source with an empty name.
    """
    us = F.col("__us")
    start = F.expr(f"(__us - pmod(__us, {period * 1_000_000}L)) div 1000000")
    e = events.where(F.col(ts).isNotNull()).withColumn("__us", seconds(ts)).withColumn("period_start", start)
    delay = seconds(arrival) - (F.col("period_start") + period) * 1_000_000
    return e.withColumns({"delay_us": F.coalesce(delay, F.lit(0)), "__src": F.coalesce(F.col(source), F.lit(""))}).drop(us)


def low_watermarks(events: DataFrame, arrival: str = "arrival", period: int = PERIOD, lateness: int = LATENESS, idle: int = IDLE) -> DataFrame:
    """``(period_start, __src, bound_us, punctuated_us, passed_us, active)`` for every source and every period there is.

    ``punctuated_us`` is the source's first arrival past the bound, null if it shows none; ``passed_us`` the time from
    which it holds the period open no longer: that arrival, or ``idle`` after the bound if it comes later or never.
    ``events`` come from ``periods``. One aggregation per source and arrival period leaves a row for each stretch of
    elapsed time, so that what is sorted per source follows time, not events.
    """
    late, long = lateness * 1_000_000, period * 1_000_000
    # an arrival lies past the bounds of all periods up to the one of its slot
    slot = F.expr(f"(unix_micros({arrival}) - 1 - {late}L - pmod(unix_micros({arrival}) - 1 - {late}L, {long}L)) div {long}L")
    seen = events.groupBy("__src", "period_start", slot.alias("slot")).agg(F.min(seconds(arrival)).alias("first"))
    marks = seen.where(F.col("slot").isNotNull()).groupBy("__src", "slot").agg(F.min("first").alias("first"))
    sources = [r["__src"] for r in seen.select("__src").distinct().collect()]  # the producers, as many as are declared
    every = seen.select("period_start").distinct().withColumn("__src", F.explode(F.array(*map(F.lit, sources)) if sources else F.array(F.lit(""))))
    asked = every.select("__src", F.expr(f"period_start div {period}L + 1").alias("slot"), F.lit(None).cast("bigint").alias("first"), "period_start")
    both = marks.select("__src", "slot", "first", F.lit(None).cast("bigint").alias("period_start")).unionByName(asked)
    ahead = Window.partitionBy("__src").orderBy(F.col("slot"), F.col("first").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    bound = (F.col("period_start") + period) * 1_000_000 + late
    m = both.withColumn("punctuated_us", F.min("first").over(ahead)).where(F.col("period_start").isNotNull()).withColumn("bound_us", bound)
    active = F.coalesce(F.col("punctuated_us") - F.col("bound_us") <= idle * 1_000_000, F.lit(False))
    passed = F.when(active, F.col("punctuated_us")).otherwise(F.col("bound_us") + idle * 1_000_000)
    return m.select("period_start", "__src", "bound_us", "punctuated_us", passed.alias("passed_us"), active.alias("active"))


def closings(marks: DataFrame) -> DataFrame:
    """``(period_start, closed_us, active_sources)``: when every source has passed each period, from ``low_watermarks``."""
    return marks.groupBy("period_start").agg(F.max("passed_us").alias("closed_us"), F.count_if("active").alias("active_sources"))


def punctuate(events: DataFrame, ts: str = "event_timestamp", arrival: str = "arrival", source: str = "source", period: int = PERIOD, lateness: int = LATENESS, idle: int = IDLE) -> DataFrame:
    """The events of ``periods`` with ``diverted``, ``closed_us`` and ``active_sources`` of their period.

    A record is diverted if its source had punctuated the period by the record's arrival. The punctuations go to all
    tasks if they are few enough, which is counted; else they are joined by source and period, where AQE splits what is
    skewed. ``events`` are read twice, so they should be written down.
    """
    e = periods(events, ts, arrival, source, period)
    marks = materialise(low_watermarks(e, arrival, period, lateness, idle), "watermarks")
    m = marks.join(closings(marks), "period_start").select("period_start", "__src", "punctuated_us", "closed_us", "active_sources")
    if marks.count() <= BROADCAST_MARKS:
        m = F.broadcast(m)
    joined = e.join(m, ["period_start", "__src"])
    return joined.withColumn("diverted", F.coalesce(seconds(arrival) >= F.col("punctuated_us"), F.lit(False))).drop("punctuated_us", "__src")


def diverted(events: DataFrame) -> DataFrame:
    """The events beyond their source's bound, beside the time their period closed for all sources."""
    return events.where("diverted")


def corrected_counts(events: DataFrame, kinds: tuple[str, ...], kind: str = "event_type", arrival: str = "arrival") -> DataFrame:
    """For each period: first counts at its end, final counts at its closing, corrections, diverted events, closing time.

    ``events`` come from ``punctuate``. Kinds outside ``kinds`` (null too) count in n_other. ``n_after_close`` are the
    diverted events that came when the period was closed for all sources; the other diverted ones met a period that
    another source still held open.
    """
    on_time, late = F.col("delay_us") <= 0, ~F.col("diverted")
    one = {k: F.coalesce(F.col(kind) == k, F.lit(False)) for k in kinds}
    one["other"] = ~F.coalesce(F.col(kind).isin(*kinds), F.lit(False))
    agg = [F.count_if(c & on_time).alias(f"first_{k}") for k, c in one.items()] + [F.count_if(c & late).alias(f"n_{k}") for k, c in one.items()]
    after = F.col("diverted") & (seconds(arrival) >= F.col("closed_us"))
    closed = [F.expr("max(closed_us) div 1000000").alias("closed_at"), F.max("active_sources").alias("active_sources")]
    return events.groupBy("period_start").agg(*agg, F.count_if(late & ~on_time).alias("corrections"), F.count_if("diverted").alias("n_diverted"), F.count_if(after).alias("n_after_close"), *closed)
