"""Kafka-like messages of all four topics, from the test tables.

Clicks are the messages of ad_clicks as they are. The other topics have no table of their own; their messages are made
from processed_events, by writing each row in the wire format of its source. Their partition and offset follow from
hashes, ingestion time is updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.schemas import EVENT_TYPES, REPLAY_EPOCH
from tidewell.sources.tables import load


def _native() -> Column:
    c = F.col
    return F.to_json(
        F.struct(
            "event_id", "event_type", "source", "auction_id", "campaign_id", "banner_id", "site_cat", "device_type", "os", "country", "uid",
            c("cost").alias("bid_price"), F.unix_seconds("event_timestamp").alias("timestamp"),
        )
    )


def _replay() -> Column:
    part = F.split("banner_id", "_")
    return F.to_json(
        F.struct(
            "event_id", "event_type", "source", "auction_id", F.col("campaign_id").alias("campaign"), "uid", (F.col("cost") / 1000).alias("cost"), "conversion",
            (F.unix_seconds("event_timestamp") - REPLAY_EPOCH).alias("timestamp"),
            F.get(part, 1).try_cast("bigint").alias("cat1"), F.get(part, 2).try_cast("bigint").alias("cat2"),
        )
    )


def records(spark: SparkSession, d: str, event_type: str) -> DataFrame:
    """``key, value, topic, partition, offset, timestamp, ingested_at`` of one topic."""
    if event_type == "click":
        a = load(spark, d, "ad_clicks")
        return a.select("key", "value", "topic", F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.col("kafka_timestamp").alias("timestamp"), "ingested_at")
    e = load(spark, d, "processed_events").where(F.col("event_type") == event_type)
    value = F.when(F.col("source") == "dummy", _native()).otherwise(_replay())
    return e.select(
        F.col("campaign_id").cast("string").alias("key"), value.alias("value"), F.lit(f"ad-{event_type}s").alias("topic"),
        F.pmod("campaign_id", F.lit(3)).cast("int").alias("partition"), F.unix_micros("updated_at").alias("offset"), F.col("updated_at").alias("timestamp"), F.col("updated_at").alias("ingested_at"),
    )


def messages_of(events: DataFrame) -> DataFrame:
    """``key, value, topic`` of wire events: the campaign as key, so that a campaign's events stay in one partition and in
    order; the whole row as JSON; the topic by event type."""
    topic = F.concat(F.lit("ad-"), F.col("event_type"), F.lit("s"))
    return events.select(F.col("campaign_id").cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"), topic.alias("topic"))


def produce(messages: DataFrame, servers: str | None = None, landing: str | None = None) -> None:
    """Sends each message to its topic at a broker (needs Spark's Kafka package), or to a landing folder, from which
    ``streaming.ingest.file_stream`` reads. Rows without topic are left out."""
    m = messages.where(F.col("topic").isNotNull())
    if servers:
        m.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    if landing:
        stamped = m.select("key", "value", "topic", F.pmod(F.xxhash64("key"), F.lit(3)).cast("int").alias("partition"), F.monotonically_increasing_id().alias("offset"), F.current_timestamp().alias("timestamp"))
        stamped.write.mode("append").parquet(landing)


def project_bronze(rec: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Broker records as Bronze rows: text of key and value, metadata renamed, day and hour of the broker's timestamp."""
    return rec.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", F.col("partition").cast("int").alias("kafka_partition"),
        F.col("offset").cast("bigint").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"), (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("dt"), F.hour("timestamp").alias("hour"),
    )


def bronze_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {f"ad_{t}s": project_bronze(records(spark, d, t), F.col("ingested_at")) for t in EVENT_TYPES}
