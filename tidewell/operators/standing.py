"""One row for each event: the one with the earliest updated_at stands for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.ids import bare_id


def standing_events(events: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the row that stands for each event, with its bare identifier as ``event_id``.

    Ties in updated_at are broken by the values of ``columns`` in order, a null updated_at comes last, a row with null
    event_id is an event of its own. Rows without identifier never meet in a task: they pass beside the aggregation,
    which combines copies before its only exchange, so that no group of copies is gathered.
    """
    keep = [c for c in columns if c not in ("event_id", "updated_at")]
    ident = bare_id("event_id")
    rank = F.struct(F.col("updated_at").isNull().alias("missing"), "updated_at", *keep)
    known = events.where(ident.isNotNull()).groupBy(ident.alias("event_id")).agg(F.min(rank).alias("r"))
    known = known.select("event_id", "r.updated_at", *(F.col(f"r.{c}").alias(c) for c in keep))
    alone = events.where(ident.isNull()).select(F.lit(None).cast("string").alias("event_id"), "updated_at", *keep)
    return known.unionByName(alone)
