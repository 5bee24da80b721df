"""Streaming forms of the session, lateness and duplicate operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import scratch

GAP = "30 minutes"


def stream_sessions(events: DataFrame, key: str = "uid", ts: str = "event_timestamp", gap: str = GAP, lateness: str = "24 hours") -> DataFrame:
    """Sessions of a stream: intervals merge in state until the watermark has passed them; late events within the
    lateness may still join two sessions. Append mode emits each session once it is closed."""
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, lateness)
    s = e.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n_events"))
    return s.select(key, F.unix_seconds("first").alias("session_start"), F.unix_seconds("last").alias("session_end"), "n_events")


def drain_sessions(events: DataFrame, key: str = "uid", ts: str = "event_timestamp", arrived: str = "updated_at", gap: str = GAP, lateness: str = "4 days", files: int = 4) -> DataFrame:
    """``stream_sessions`` of a table, its rows landing day of arrival after day of arrival, drained to the end.

    Rows that come later than ``lateness`` behind the newest event are dropped, as the stream drops them. A last row,
    far ahead, moves the watermark past all sessions; its own never closes. Rows without arrival come first.
    """
    spark, landing, root = events.sparkSession, scratch(events.sparkSession, "arrivals"), scratch(events.sparkSession, "sessions")
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key), F.col(ts), F.coalesce(F.to_date(arrived).cast("string"), F.lit("")).alias("day"))
    days = sorted(r["day"] for r in e.select("day").distinct().collect())  # a row a day
    for d in days:
        e.where(F.col("day") == d).drop("day").repartition(files).write.mode("append").parquet(landing)
    ahead = e.agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull()).select(F.lit("").cast(e.schema[key].dataType).alias(key), (F.col(ts) + F.expr("INTERVAL 3650 DAYS")).alias(ts))
    ahead.coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(e.drop("day").schema).option("maxFilesPerTrigger", files).parquet(landing)
    out = stream_sessions(stream, key, ts, gap, lateness)
    w = out.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def stream_hourly(sources: dict[str, DataFrame], ts: str = "event_timestamp", lateness: str = "24 hours") -> DataFrame:
    """Hourly counts by event time over several sources, each with its own watermark. With
    ``spark.sql.streaming.multipleWatermarkPolicy`` at its default ``min`` an hour closes when every source has passed."""
    parts = [s.where(F.col(ts).isNotNull()).withWatermark(ts, lateness).select(ts, "event_type") for s in sources.values()]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(F.window(ts, "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("period_start"), "event_type", "n")


def stream_unique(messages: DataFrame, ident: str, ts: str, lateness: str = "24 hours") -> DataFrame:
    """One row for each identifier among those less than the lateness apart; older state is dropped."""
    return messages.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([ident])
