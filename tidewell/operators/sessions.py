"""Sessions of activity by merging interval state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_SECONDS = 1800


def sessionize(
    events: DataFrame, key: str, ts: str, kind: str | None = None, kinds: tuple[str, ...] = (), gap_seconds: int = GAP_SECONDS
) -> DataFrame:
    """Sessions ``(key, session_start, session_end, duration_sec, n_events, n_<kind>..., n_other)``, times in epoch seconds.

    Every event opens an interval of the gap's length; intervals of one key that overlap or touch merge, so a session
    starts when *more* than the gap has passed. Events of one key within one gap-wide slot of time always share a
    session. They are therefore merged by a hash aggregation first, which combines on the map side; what is left of a
    key, however many events it has, is at most one interval for each gap of elapsed time, and only those are sorted and
    merged. No key can gather its rows in one task.

    Events with null key or time belong to no session. An empty table gives no session; repeated rows count as events;
    fractions of a second count for the gap and are cut off in the result; null and undeclared kinds count as n_other.
    Other columns are ignored.
    """
    gap = gap_seconds * 1_000_000
    at = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("k"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"),
    )
    counts = {f"n_{x}": F.count_if(F.col("kind") == x) for x in kinds}
    if kind:
        counts["n_other"] = F.count_if(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)))
    slot = F.expr(f"us div {gap} - if(us % {gap} < 0, 1, 0)")  # the floor, in whole numbers
    slots = at.groupBy("k", slot.alias("slot")).agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n_events"), *(v.alias(n) for n, v in counts.items())
    )
    width = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, cast((hi - lo + {gap}) / 1000000 as decimal(18, 6)))")
    merged = slots.groupBy("k", F.session_window(F.timestamp_micros("lo"), width).alias("w")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(F.sum(n).alias(n) for n in ("n_events", *counts))
    )
    start, end = (F.floor(F.col(c) / 1_000_000).cast("bigint") for c in ("lo", "hi"))
    return merged.select(
        F.col("k").alias(key), start.alias("session_start"), end.alias("session_end"), (end - start).alias("duration_sec"), "n_events", *counts
    )
