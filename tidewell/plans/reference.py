"""Queries of the funnel engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.ids import bare_id
from tidewell.plans import generate, gold, health, silver
from tidewell.plans.problems import _BARE, _UUID
from tidewell.schemas import BRONZE, BRONZE_PARTITION, EVENT_TYPES, REPLAY_EPOCH, SILVER, SITE_CATEGORIES, bronze_table_of, topic_of
from tidewell.session import scratch
from tidewell.sources import wire
from tidewell.sources.tables import load
from tidewell.streaming import ingest
from tidewell.table import maintenance
from tidewell.table.managed import ManagedTable

AS_OF = "2024-01-08 00:00:00"
SPLIT = "2024-01-04 00:00:00"
CAMPAIGN_DDL = "campaign_id int, event_date date, requests bigint, impressions bigint, clicks bigint, conversions bigint, fill_rate double, ctr double, cvr double, cost double, cpa double, roas double, updated_at timestamp"
BANNER_DDL = "banner_id string, event_date date, impressions bigint, clicks bigint, ctr double, peak_hour int, cost double, updated_at timestamp"
HOURLY_DDL = "event_date date, hour int, requests bigint, impressions bigint, clicks bigint, conversions bigint, fill_rate double, ctr double, cvr double, updated_at timestamp"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


_NOW = f"TIMESTAMPTZ '{AS_OF}+00'"
_SPLIT = f"TIMESTAMPTZ '{SPLIT}+00'"
_JSON = "CASE WHEN json_valid(value) THEN value END"
_RULES = f"""CASE WHEN event_id IS NULL THEN 'null_event_id' WHEN event_type IS NULL OR event_type NOT IN ('request', 'impression', 'click', 'conversion') THEN 'bad_event_type'
 WHEN campaign_id IS NULL THEN 'null_campaign_id' WHEN uid IS NULL THEN 'null_uid' WHEN cost < 0 THEN 'negative_cost'
 WHEN event_timestamp IS NULL OR event_timestamp < TIMESTAMPTZ '2020-01-01 00:00:00+00' OR event_timestamp > {_NOW} + INTERVAL 1 DAY THEN 'timestamp_out_of_range' END"""
_TAGGED = f"t AS (SELECT *, {_BARE} AS id, {_RULES} AS reject_reason FROM processed_events)"


def _latest(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT * EXCLUDE (event_id), {_UUID.format('id')} AS event_id FROM t WHERE reject_reason IS NULL AND {where} QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"


_SILVER = f"{_TAGGED}, {_latest('s')}"
_HOUR = "cast(hour(event_timestamp AT TIME ZONE 'UTC') AS int)"
_CNT = "count(*) FILTER (event_type = 'request') AS requests, count(*) FILTER (event_type = 'impression') AS impressions, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'conversion') AS conversions"
_RATIOS = "round(impressions / nullif(requests, 0), 6) AS fill_rate, round(clicks / nullif(impressions, 0), 6) AS ctr, round(conversions / nullif(clicks, 0), 6) AS cvr"
_COST = "round(sum(CASE WHEN event_type = 'click' THEN cost ELSE 0.0 END), 6) AS cost"


def _campaign_sql(table: str) -> str:
    return f"SELECT campaign_id, event_date, requests, impressions, clicks, conversions, {_RATIOS}, cost, round(cost / nullif(conversions, 0), 6) AS cpa, round(conversions * 10.0 / nullif(cost, 0), 6) AS roas FROM (SELECT campaign_id, event_date, {_CNT}, {_COST} FROM {table} GROUP BY ALL)"


_BANNER = f"""g AS (SELECT banner_id, event_date, count(*) FILTER (event_type = 'impression') AS impressions, count(*) FILTER (event_type = 'click') AS clicks, {_COST} FROM s GROUP BY ALL),
 p AS (SELECT banner_id, event_date, {_HOUR} AS peak_hour, count(*) AS n FROM s WHERE event_type = 'impression' GROUP BY banner_id, event_date, 3 QUALIFY row_number() OVER (PARTITION BY banner_id, event_date ORDER BY n DESC, peak_hour) = 1),
 b AS (SELECT g.banner_id, g.event_date, impressions, clicks, round(clicks / nullif(impressions, 0), 6) AS ctr, peak_hour, cost FROM g LEFT JOIN p ON g.banner_id = p.banner_id AND g.event_date = p.event_date)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "processed_events")


def _silver(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """The merged state of Silver: valid rows, the latest of each event."""
    e = _events(spark, d) if rows is None else rows
    return silver.dedup_latest(silver.valid(e, now()), [F.desc("updated_at")])


def _raw_clicks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ad_clicks").select("value", *silver.CARRIED)


def _campaigns(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "campaign_daily_stats")


def _table(spark: SparkSession, name: str, schema: str, partition: list[str] | None = None, **props) -> ManagedTable:
    return ManagedTable.create_if_not_exists(spark, scratch(spark, name), schema, partition, props, name)


# --- Bronze ----------------------------------------------------------------------------------------------------------


@query("SELECT key, value, topic, kafka_partition, kafka_offset, epoch_us(kafka_timestamp) AS kafka_us, strftime(kafka_timestamp AT TIME ZONE 'UTC', '%Y-%m-%d') AS dt, cast(hour(kafka_timestamp AT TIME ZONE 'UTC') AS int) AS hour FROM ad_clicks")
def bronze_raw_projection(spark: SparkSession, d: str) -> DataFrame:
    b = wire.project_bronze(wire.records(spark, d, "click"), now())
    return b.select("key", "value", "topic", "kafka_partition", "kafka_offset", F.unix_micros("kafka_timestamp").alias("kafka_us"), "dt", "hour")


@query("SELECT 'ad_clicks' AS tbl, count(*) AS cnt FROM ad_clicks UNION ALL SELECT 'ad_' || event_type || 's', count(*) FROM processed_events WHERE event_type IN ('request', 'impression', 'conversion') GROUP BY event_type")
def bronze_topic_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(n).alias("tbl"), "cnt") for n, df in wire.bronze_tables(spark, d).items()]
    return reduce(DataFrame.unionAll, parts)


@query(f"SELECT json_extract_string({_JSON}, '$.source') AS source, count(*) AS cnt FROM ad_clicks GROUP BY 1")
def bronze_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ad_clicks").groupBy(F.get_json_object("value", "$.source").alias("source")).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT dt, hour, count(*) AS cnt FROM ad_clicks GROUP BY ALL ORDER BY dt, hour")
def bronze_partition_distribution(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ad_clicks").groupBy("dt", "hour").agg(F.count(F.lit(1)).alias("cnt")).orderBy("dt", "hour")


@query("SELECT hour, count(*) AS cnt FROM ad_clicks WHERE dt = '2024-01-03' GROUP BY hour ORDER BY hour")
def bronze_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ad_clicks").where(F.col("dt") == "2024-01-03").groupBy("hour").agg(F.count(F.lit(1)).alias("cnt")).orderBy("hour")


def _window(spark: SparkSession, d: str, as_of: str, **kw) -> DataFrame:
    w = silver.read_window(list(wire.bronze_tables(spark, d).values()), now(as_of), **kw)
    return w.agg(F.count(F.lit(1)).alias("cnt"), F.min(F.unix_micros("ingested_at")).alias("first_us"), F.max(F.unix_micros("ingested_at")).alias("last_us"))


_FOUR = """b AS (SELECT dt, hour, ingested_at FROM ad_clicks UNION ALL SELECT strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d'), hour(updated_at AT TIME ZONE 'UTC'), updated_at FROM processed_events WHERE event_type IN ('request', 'impression', 'conversion'))"""
_WINDOWED = f"WITH {_FOUR} SELECT count(*) AS cnt, min(epoch_us(ingested_at)) AS first_us, max(epoch_us(ingested_at)) AS last_us FROM b WHERE "


@query(_WINDOWED + "dt >= '2024-01-03'")
def bronze_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    return _window(spark, d, "2024-01-05 06:00:00", window_days=2)


@query(_WINDOWED + "ingested_at >= TIMESTAMPTZ '2024-01-05 03:00:00+00'")
def bronze_incremental_window(spark: SparkSession, d: str) -> DataFrame:
    return _window(spark, d, "2024-01-05 06:00:00", lookback_hours=3)


@query(_WINDOWED + "dt >= '2024-01-03' AND hour = 9")
def bronze_hour_slice(spark: SparkSession, d: str) -> DataFrame:
    return _window(spark, d, "2024-01-05 06:00:00", window_days=2, hour=9)


def _bronze(spark: SparkSession, d: str) -> dict[str, ManagedTable]:
    """The four Bronze tables, by day and hour."""
    made = {n: _table(spark, f"bronze.{n}", BRONZE, BRONZE_PARTITION, stats=["ingested_at"]) for n in wire.bronze_tables(spark, d)}
    for n, df in wire.bronze_tables(spark, d).items():
        made[n].append(df)
    return made


_WINDOWS = {"sliding": ("dt >= '2024-01-03'", {"window_days": 2}), "lookback": ("ingested_at >= TIMESTAMPTZ '2024-01-05 03:00:00+00'", {"lookback_hours": 3}), "hour": ("dt >= '2024-01-03' AND hour = 9", {"window_days": 2, "hour": 9})}


@query(f"WITH {_FOUR} " + " UNION ALL ".join(f"SELECT '{n}' AS win, count(*) AS cnt FROM b WHERE {w}" for n, (w, _) in _WINDOWS.items()))
def bronze_table_windows(spark: SparkSession, d: str) -> DataFrame:
    """The three kinds of window over managed tables, whose files are pruned before they are opened."""
    tables = list(_bronze(spark, d).values())
    at = dt.datetime(2024, 1, 5, 6)
    parts = [silver.scan_window(tables, at, **kw).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(n).alias("win"), "cnt") for n, (_, kw) in _WINDOWS.items()]
    return reduce(DataFrame.unionAll, parts)


# --- Silver ----------------------------------------------------------------------------------------------------------

_OUT = ["event_id", "event_type", "source", "auction_id", "campaign_id", "event_epoch", "event_date", "uid", "banner_id", "site_cat", "device_type", "os", "country", "cost", "conversion"]


def _shown(e: DataFrame) -> DataFrame:
    return e.withColumn("event_epoch", F.unix_seconds("event_timestamp")).withColumn("cost", F.round("cost", 6)).select(*_OUT)


def _num(f: str, t: str = "bigint") -> str:
    kinds = "'UBIGINT', 'BIGINT'" + (", 'DOUBLE'" if t == "double" else "")
    return f"CASE WHEN json_type(j, '$.{f}') IN ({kinds}) THEN try_cast(json_extract_string(j, '$.{f}') AS {t}) END"


def _str(f: str) -> str:
    return f"json_extract_string(j, '$.{f}')"


def _parse_sql(source: str, more: str = "") -> str:
    common = f"{more}{_str('event_id')} AS event_id, {_str('event_type')} AS event_type, '{source}' AS source, {_str('auction_id')} AS auction_id"
    conv = f"CASE WHEN {_str('event_type')} = 'conversion' THEN 1 ELSE 0 END AS conversion"
    frm = f"FROM (SELECT *, json({_JSON}) AS j FROM ad_clicks) WHERE json_type(j) = 'OBJECT' AND json_extract_string(j, '$.source') = '{source}'"
    if source == "dummy":
        epoch = _num("timestamp")
        rest = f"{_num('campaign_id', 'int')} AS campaign_id, {epoch} AS event_epoch, {_str('uid')} AS uid, {_str('banner_id')} AS banner_id, {_str('site_cat')} AS site_cat, {_num('device_type', 'int')} AS device_type, {_str('os')} AS os, {_str('country')} AS country, round({_num('bid_price', 'double')}, 6) AS cost"
    else:
        epoch = f"{_num('timestamp')} + {REPLAY_EPOCH}"
        cats = "[" + ", ".join(f"'{c}'" for c in SITE_CATEGORIES) + "]"
        rest = f"{_num('campaign', 'int')} AS campaign_id, {epoch} AS event_epoch, {_str('uid')} AS uid, concat_ws('_', {_num('campaign', 'int')}, {_num('cat1')}, {_num('cat2')}) AS banner_id, {cats}[(({_num('cat1')}) % 8 + 1)] AS site_cat, NULL::int AS device_type, NULL::varchar AS os, NULL::varchar AS country, round({_num('cost', 'double')} * 1000, 6) AS cost"
    return f"SELECT {common}, {rest}, {conv}, cast(to_timestamp({epoch}) AT TIME ZONE 'UTC' AS date) AS event_date {frm}"


_PARSED = f"({_parse_sql('dummy')}) UNION ALL BY NAME ({_parse_sql('criteo')})"


@query(_parse_sql("dummy"))
def silver_parse_native(spark: SparkSession, d: str) -> DataFrame:
    return _shown(silver.parse_native(_raw_clicks(spark, d)))


@query(_parse_sql("criteo"))
def silver_parse_replay(spark: SparkSession, d: str) -> DataFrame:
    return _shown(silver.parse_replay(_raw_clicks(spark, d)))


@query(_PARSED)
def silver_unified(spark: SparkSession, d: str) -> DataFrame:
    return _shown(silver.unify(_raw_clicks(spark, d)))


@query(f"WITH {_TAGGED} SELECT reject_reason, count(*) AS cnt FROM t WHERE reject_reason IS NOT NULL GROUP BY 1")
def silver_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return silver.reject_profile(_events(spark, d), now())


@query(f"WITH {_TAGGED} SELECT event_id, event_type, campaign_id, uid, cost, epoch_us(updated_at) AS updated_us FROM t WHERE reject_reason IS NULL")
def silver_valid_events(spark: SparkSession, d: str) -> DataFrame:
    return silver.valid(_events(spark, d), now()).select("event_id", "event_type", "campaign_id", "uid", "cost", F.unix_micros("updated_at").alias("updated_us"))


@query(f"WITH {_SILVER} SELECT event_id, event_type, cost, epoch_us(updated_at) AS updated_us FROM s")
def silver_dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return _silver(spark, d).select("event_id", "event_type", "cost", F.unix_micros("updated_at").alias("updated_us"))


_DELAY = f"""{_SILVER}, k AS (SELECT auction_id, min(event_timestamp) AS click_ts FROM s WHERE event_type = 'click' AND auction_id IS NOT NULL GROUP BY 1),
 c AS (SELECT event_id, epoch_us(event_timestamp) // 1000000 - epoch_us(click_ts) // 1000000 AS conversion_delay_sec FROM s LEFT JOIN k USING (auction_id) WHERE event_type = 'conversion')"""


def _delayed(spark: SparkSession, d: str) -> DataFrame:
    return silver.conversion_delay(_silver(spark, d)).where(F.col("event_type") == "conversion").select("event_id", "conversion_delay_sec")


@query(f"WITH {_DELAY} SELECT * FROM c")
def silver_conversion_delay(spark: SparkSession, d: str) -> DataFrame:
    return _delayed(spark, d)


@query(f"""WITH {_TAGGED}, {_latest('s')}, stored AS (SELECT * FROM s WHERE updated_at < {_SPLIT}), batch AS (SELECT * FROM s WHERE updated_at >= {_SPLIT}),
 k AS (SELECT auction_id, min(event_timestamp) AS click_ts FROM s WHERE event_type = 'click' AND auction_id IS NOT NULL GROUP BY 1)
 SELECT event_id, epoch_us(event_timestamp) // 1000000 - epoch_us(click_ts) // 1000000 AS conversion_delay_sec FROM batch LEFT JOIN k USING (auction_id) WHERE event_type = 'conversion'""")
def silver_stored_clicks(spark: SparkSession, d: str) -> DataFrame:
    """Delays of a batch's conversions, whose clicks came with the batch or are stored already."""
    s = _silver(spark, d)
    t = _table(spark, "silver.processed_events", SILVER, ["event_date"])
    t.append(s.where(F.col("updated_at") < now(SPLIT)))
    e = silver.conversion_delay(s.where(F.col("updated_at") >= now(SPLIT)), t.scan())
    return e.where(F.col("event_type") == "conversion").select("event_id", "conversion_delay_sec")


@query(f"WITH {_DELAY} SELECT count(*) AS conversions, count(conversion_delay_sec) AS delay_filled, min(conversion_delay_sec) AS min_delay_sec, round(avg(conversion_delay_sec), 4) AS avg_delay_sec, max(conversion_delay_sec) AS max_delay_sec FROM c")
def silver_delay_stats(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("conversion_delay_sec")
    return _delayed(spark, d).agg(F.count(F.lit(1)).alias("conversions"), F.count(s).alias("delay_filled"), F.min(s).alias("min_delay_sec"), F.round(F.avg(s), 4).alias("avg_delay_sec"), F.max(s).alias("max_delay_sec"))


_VIEWED = "SELECT event_type, count(*) AS cnt, count(DISTINCT campaign_id) AS campaigns FROM {0} WHERE event_date >= DATE '2024-01-03' GROUP BY event_type"


@query(f"WITH {_SILVER} {_VIEWED.format('s')}")
def silver_sql_view(spark: SparkSession, d: str) -> DataFrame:
    """SQL over a managed table that is registered as a view."""
    t = _table(spark, "silver.processed_events", SILVER, ["event_date"])
    t.append(_silver(spark, d))
    t.view("managed_silver", where=lambda p: (p["event_date"] or "") >= "2024-01-03")
    return spark.sql(_VIEWED.format("managed_silver"))


@query("SELECT source, event_type, count(*) AS cnt FROM processed_events GROUP BY ALL ORDER BY source, event_type")
def silver_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("cnt")).orderBy("source", "event_type")


@query("SELECT event_date, event_type, count(*) AS cnt FROM processed_events GROUP BY ALL ORDER BY event_date, event_type")
def silver_date_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("event_date", "event_type").agg(F.count(F.lit(1)).alias("cnt")).orderBy("event_date", "event_type")


@query(f"SELECT count(*) - count(DISTINCT {_BARE}) AS duplicate_event_ids FROM processed_events")
def silver_duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).agg((F.count(F.lit(1)) - F.count_distinct(bare_id("event_id"))).alias("duplicate_event_ids"))


@query("SELECT count(*) AS null_key_rows FROM processed_events WHERE event_id IS NULL OR campaign_id IS NULL OR uid IS NULL")
def silver_null_keys(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_id IS NULL OR campaign_id IS NULL OR uid IS NULL").agg(F.count(F.lit(1)).alias("null_key_rows"))


@query("SELECT count(*) AS negative_cost_rows FROM processed_events WHERE cost < 0")
def silver_negative_cost(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("cost < 0").agg(F.count(F.lit(1)).alias("negative_cost_rows"))


@query("SELECT event_id, source, event_type, campaign_id, banner_id, site_cat, cost, epoch_us(event_timestamp) AS event_us, conversion FROM processed_events WHERE source = 'criteo' AND event_id IS NOT NULL ORDER BY event_id, updated_at LIMIT 10")
def silver_replay_sample(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("source = 'criteo' AND event_id IS NOT NULL").orderBy("event_id", "updated_at").limit(10)
    return e.select("event_id", "source", "event_type", "campaign_id", "banner_id", "site_cat", "cost", F.unix_micros("event_timestamp").alias("event_us"), "conversion")


_COMPARED = [c.split()[0] for c in SILVER.split(", ") if c.split()[0] not in ("event_id", "updated_at")]
_MERGE = f"""WITH {_TAGGED}, {_latest('b1', f'updated_at < {_SPLIT}')}, {_latest('b2', f'updated_at >= {_SPLIT}')},
 m AS (SELECT coalesce(b2.event_id, b1.event_id) AS event_id, CASE WHEN b2.event_id IS NULL THEN b1.event_date ELSE b2.event_date END AS event_date,
  CASE WHEN b2.event_id IS NULL THEN b1.cost ELSE b2.cost END AS cost,
  epoch_us(CASE WHEN b2.event_id IS NULL OR ({' AND '.join(f'b1.{c} IS NOT DISTINCT FROM b2.{c}' for c in _COMPARED)}) AND b1.event_id IS NOT NULL THEN b1.updated_at ELSE b2.updated_at END) AS updated_us
  FROM b1 FULL JOIN b2 ON b1.event_id = b2.event_id) SELECT * FROM m"""


def _merged(spark: SparkSession, d: str) -> ManagedTable:
    t = _table(spark, "silver.processed_events", SILVER, ["event_date"])
    e = _events(spark, d)
    t.merge(_silver(spark, d, e.where(F.col("updated_at") < now(SPLIT))), "event_id")
    t.merge(_silver(spark, d, e.where(F.col("updated_at") >= now(SPLIT))), "event_id")
    return t


@query(_MERGE)
def silver_merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).scan().select("event_id", "event_date", "cost", F.unix_micros("updated_at").alias("updated_us"))


_CAME = "ingested_at, kafka_partition, kafka_offset, "
_PIPELINE = f"""WITH c AS (({_parse_sql('dummy', _CAME)}) UNION ALL BY NAME ({_parse_sql('criteo', _CAME)})),
 o AS (SELECT event_id, event_type, source, auction_id, campaign_id, uid, cost, event_timestamp, updated_at AS ingested_at, ((campaign_id % 3) + 3) % 3 AS kafka_partition, epoch_us(updated_at) AS kafka_offset
  FROM processed_events WHERE event_type IN ('request', 'impression', 'conversion') AND source IN ('dummy', 'criteo')),
 processed_events AS (SELECT event_id, event_type, source, auction_id, campaign_id, uid, cost, to_timestamp(event_epoch) AS event_timestamp, ingested_at, kafka_partition, kafka_offset FROM c UNION ALL BY NAME SELECT * FROM o),
 {_TAGGED}, s AS (SELECT * FROM t WHERE reject_reason IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, kafka_partition DESC, kafka_offset DESC) = 1),
 k AS (SELECT DISTINCT auction_id FROM s WHERE event_type = 'click' AND auction_id IS NOT NULL)
 SELECT source, event_type, count(*) AS cnt, count(k.auction_id) FILTER (event_type = 'conversion') AS delays FROM s LEFT JOIN k ON s.auction_id = k.auction_id GROUP BY source, event_type"""


@query(_PIPELINE)
def silver_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain over all four topics: parse, validate, deduplicate, enrich; rows by source and type."""
    raw = silver.read_window(list(wire.bronze_tables(spark, d).values()), now())
    return silver.silver_batch(raw, now()).groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("cnt"), F.count("conversion_delay_sec").alias("delays"))


# --- Gold ------------------------------------------------------------------------------------------------------------


@query(f"WITH {_SILVER} {_campaign_sql('s')}")
def gold_campaign_daily(spark: SparkSession, d: str) -> DataFrame:
    return gold.campaign_daily(_silver(spark, d))


@query(f"WITH {_SILVER}, {_BANNER} SELECT * FROM b")
def gold_banner_daily(spark: SparkSession, d: str) -> DataFrame:
    return gold.banner_daily(_silver(spark, d))


@query(f"WITH {_SILVER} SELECT event_date, hour, requests, impressions, clicks, conversions, {_RATIOS} FROM (SELECT event_date, {_HOUR} AS hour, {_CNT} FROM s GROUP BY ALL)")
def gold_hourly_funnel(spark: SparkSession, d: str) -> DataFrame:
    return gold.hourly_funnel(_silver(spark, d))


@query(f"SELECT DISTINCT event_date FROM processed_events WHERE updated_at >= {_NOW} - INTERVAL 1 DAY")
def gold_affected_dates(spark: SparkSession, d: str) -> DataFrame:
    return gold.affected_dates(_events(spark, d), now(), 1)


@query(f"""WITH {_TAGGED}, {_latest('s')}, {_latest('b1', f'updated_at < {_SPLIT}')}, old AS ({_campaign_sql('b1')}), new AS ({_campaign_sql('s')}),
 a AS (SELECT DISTINCT event_date FROM s WHERE updated_at >= {_NOW} - INTERVAL 3 DAY)
 SELECT * FROM old WHERE event_date NOT IN (SELECT event_date FROM a) UNION ALL SELECT * FROM new WHERE event_date IN (SELECT event_date FROM a)""")
def gold_incremental_overwrite(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, "gold.campaign_daily_stats", CAMPAIGN_DDL, ["event_date"])
    e = _events(spark, d)
    gold.refresh(_silver(spark, d, e.where(F.col("updated_at") < now(SPLIT))), {gold.campaign_daily: t}, now(SPLIT), None)
    gold.refresh(_silver(spark, d), {gold.campaign_daily: t}, now(), 3)
    return t.scan().drop("updated_at")


@query("SELECT 'campaign_daily_stats' AS tbl, count(*) AS cnt, count(DISTINCT event_date) AS dates FROM campaign_daily_stats UNION ALL SELECT 'hourly_funnel', count(*), count(DISTINCT event_date) FROM hourly_funnel")
def gold_coverage(spark: SparkSession, d: str) -> DataFrame:
    parts = [load(spark, d, t).agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("event_date").alias("dates")).select(F.lit(t).alias("tbl"), "cnt", "dates") for t in ("campaign_daily_stats", "hourly_funnel")]
    return parts[0].unionAll(parts[1])


@query("SELECT sum(impressions)::bigint AS impressions, sum(clicks)::bigint AS clicks, sum(conversions)::bigint AS conversions, round(sum(cost), 2) AS cost, round(sum(clicks) / nullif(sum(impressions), 0), 4) AS ctr, round(sum(conversions) / nullif(sum(clicks), 0), 4) AS cvr, round(sum(conversions) * 10.0 / nullif(sum(cost), 0), 2) AS roas FROM campaign_daily_stats")
def kpi_totals(spark: SparkSession, d: str) -> DataFrame:
    return gold.kpi_totals(_campaigns(spark, d))


@query("SELECT campaign_id, event_date, impressions, clicks, conversions, ctr, cvr, cost, cpa, roas FROM campaign_daily_stats ORDER BY cost DESC NULLS LAST, campaign_id, event_date LIMIT 20")
def top_campaigns_cost(spark: SparkSession, d: str) -> DataFrame:
    return gold.top_campaigns(_campaigns(spark, d))


@query(f"WITH {_SILVER}, {_BANNER} SELECT * FROM b WHERE impressions >= 20 ORDER BY ctr DESC NULLS LAST, impressions DESC, banner_id, event_date LIMIT 20")
def top_banners_ctr(spark: SparkSession, d: str) -> DataFrame:
    return gold.top_banners(gold.banner_daily(_silver(spark, d)), least_impressions=20)


@query("SELECT 'bronze.ad_clicks' AS tbl, dt AS d, count(*) AS cnt FROM ad_clicks GROUP BY dt UNION ALL SELECT 'silver.processed_events', cast(event_date AS varchar), count(*) FROM processed_events GROUP BY event_date")
def rows_per_day(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "ad_clicks").groupBy(F.col("dt").alias("d")).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("bronze.ad_clicks").alias("tbl"), "d", "cnt")
    p = _events(spark, d).groupBy(F.col("event_date").cast("string").alias("d")).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("silver.processed_events").alias("tbl"), "d", "cnt")
    return a.unionAll(p).orderBy("tbl", "d")


@query("SELECT campaign_id, event_date, requests, impressions, clicks, conversions FROM campaign_daily_stats WHERE impressions > requests OR clicks > impressions OR conversions > clicks")
def funnel_violations(spark: SparkSession, d: str) -> DataFrame:
    return gold.funnel_violations(_campaigns(spark, d))


@query("SELECT campaign_id, event_date, fill_rate, ctr, cvr FROM campaign_daily_stats WHERE fill_rate NOT BETWEEN 0 AND 1 OR ctr NOT BETWEEN 0 AND 1 OR cvr NOT BETWEEN 0 AND 1")
def ratio_violations(spark: SparkSession, d: str) -> DataFrame:
    return gold.ratio_violations(_campaigns(spark, d))


@query(f"WITH {_SILVER} SELECT gold_cost, silver_click_cost, round(abs(gold_cost - silver_click_cost), 2) AS diff FROM (SELECT (SELECT coalesce(round(sum(cost), 2), 0.0) FROM campaign_daily_stats) AS gold_cost, (SELECT coalesce(round(sum(cost), 2), 0.0) FROM s WHERE event_type = 'click') AS silver_click_cost)")
def cost_consistency(spark: SparkSession, d: str) -> DataFrame:
    return gold.cost_consistency(_campaigns(spark, d), _silver(spark, d))


@query("SELECT count(*) FILTER (updated_at >= TIMESTAMPTZ '2024-01-05 00:00:00+00') AS today, count(*) AS total FROM processed_events")
def volume_today(spark: SparkSession, d: str) -> DataFrame:
    return health.volume(_events(spark, d), now("2024-01-05 12:00:00"))


_LAG = " UNION ALL ".join(f"SELECT '{t}' AS tbl, round((epoch_us({_NOW}) // 1000000 - epoch_us(max({c})) // 1000000) / 60.0, 2) AS lag_min FROM {t}" for t, c in (("click_files", "committed_at"), ("processed_events", "updated_at"), ("campaign_daily_stats", "updated_at"), ("hourly_funnel", "updated_at")))


@query(_LAG)
def freshness_minutes(spark: SparkSession, d: str) -> DataFrame:
    parts = [health.lag_minutes(load(spark, d, t), c, now()).select(F.lit(t).alias("tbl"), "lag_min") for t, c in (("click_files", "committed_at"), ("processed_events", "updated_at"), ("campaign_daily_stats", "updated_at"), ("hourly_funnel", "updated_at"))]
    return reduce(DataFrame.unionAll, parts)


_LABELS = [*(f"bronze.ad_{t}s" for t in EVENT_TYPES), "silver.processed_events", "gold.campaign_daily_stats", "gold.banner_daily_stats", "gold.hourly_funnel"]
_FIXED = ", ".join(f"('{c}', '{n}', '{s}')" for c, s in (("freshness", "OK"), ("files", "WARN"), ("snapshots", "OK")) for n in _LABELS)
_STATUS = f"""WITH {_SILVER}, m AS ({_campaign_sql('s')}), gate AS (SELECT 'volume' AS c, 'silver.processed_events' AS l, count(*) FILTER (updated_at >= {_NOW}) > 0 AS ok, 'WARN' AS bad FROM s
 UNION ALL SELECT 'duplicates', 'silver.processed_events', count(*) = count(DISTINCT event_id), 'FAIL' FROM s
 UNION ALL SELECT 'funnel', 'gold.campaign_daily_stats', count(*) FILTER (impressions > requests OR clicks > impressions OR conversions > clicks) = 0, 'FAIL' FROM m
 UNION ALL SELECT 'ratio', 'gold.campaign_daily_stats', count(*) FILTER (fill_rate NOT BETWEEN 0 AND 1 OR ctr NOT BETWEEN 0 AND 1 OR cvr NOT BETWEEN 0 AND 1) = 0, 'FAIL' FROM m
 UNION ALL SELECT 'cost', 'gold.campaign_daily_stats', abs((SELECT coalesce(round(sum(cost), 2), 0) FROM m) - (SELECT coalesce(round(sum(cost), 2), 0) FROM s WHERE event_type = 'click')) < 0.01, 'WARN')
 SELECT c AS "check", l AS label, CASE WHEN ok THEN 'OK' ELSE bad END AS status FROM gate UNION ALL SELECT * FROM (VALUES {_FIXED})"""


@query(_STATUS)
def health_status(spark: SparkSession, d: str) -> DataFrame:
    """The statuses of the report; its details hold clock times and file sizes."""
    return health_report(spark, d).select("check", "label", "status")


@query()
def health_report(spark: SparkSession, d: str) -> DataFrame:
    bronze = list(_bronze(spark, d).values())
    s = _table(spark, "silver.processed_events", SILVER, ["event_date"])
    s.append(_silver(spark, d))
    marts = {
        "gold.campaign_daily_stats": (gold.campaign_daily, CAMPAIGN_DDL), "gold.banner_daily_stats": (gold.banner_daily, BANNER_DDL), "gold.hourly_funnel": (gold.hourly_funnel, HOURLY_DDL),
    }
    tables = {}
    for n, (make, ddl) in marts.items():
        tables[n] = _table(spark, n, ddl, ["event_date"])
        tables[n].append(make(s.scan()).withColumn("updated_at", now()))
    return health.report(bronze, s, tables, now())


# --- report ----------------------------------------------------------------------------------------------------------

_ROLL = f"r AS (SELECT event_date, coalesce(sum(requests), 0)::bigint AS requests, coalesce(sum(impressions), 0)::bigint AS impressions, coalesce(sum(clicks), 0)::bigint AS clicks, coalesce(sum(conversions), 0)::bigint AS conversions, round(coalesce(sum(cost), 0), 6) AS cost FROM campaign_daily_stats WHERE event_date >= cast({_NOW} AT TIME ZONE 'UTC' AS date) - 35 GROUP BY event_date)"
_KPI = f"{_ROLL}, k AS (SELECT event_date, impressions, clicks, conversions, cost, coalesce(round(clicks / nullif(impressions, 0), 6), 0) AS ctr, coalesce(round(conversions / nullif(clicks, 0), 6), 0) AS cvr, coalesce(round(conversions * 10.0 / nullif(cost, 0), 6), 0) AS roas FROM r)"


@query(f"WITH {_ROLL} SELECT * FROM r")
def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    return gold.daily_rollup(_campaigns(spark, d), now())


def _kpis(spark: SparkSession, d: str) -> DataFrame:
    return gold.daily_kpis(gold.daily_rollup(_campaigns(spark, d), now()))


@query(f"WITH {_KPI} SELECT * FROM k")
def daily_kpis(spark: SparkSession, d: str) -> DataFrame:
    return _kpis(spark, d)


def _wow_sql() -> str:
    parts = []
    for m in ("impressions", "clicks", "conversions", "cost", "ctr", "cvr", "roas"):
        parts.append(f"SELECT '{m}' AS metric, round(a.{m}::double, 6) AS value, round((a.{m} - b.{m}) / nullif(b.{m}::double, 0) * 100, 4) AS wow_pct, round((a.{m} - c.{m}) / nullif(c.{m}::double, 0) * 100, 4) AS mom_pct FROM k a LEFT JOIN k b ON b.event_date = a.event_date - 7 LEFT JOIN k c ON c.event_date = a.event_date - 28 WHERE a.event_date = (SELECT max(event_date) FROM k)")
    return f"WITH {_KPI} " + " UNION ALL ".join(parts)


@query(_wow_sql())
def wow_mom_report(spark: SparkSession, d: str) -> DataFrame:
    k = _kpis(spark, d)
    day = k.agg(F.max("event_date").alias("d")).first()["d"]
    return gold.wow_mom(k, F.lit(day))


@query(f"SELECT CASE WHEN bool_or(event_date = cast({_NOW} AT TIME ZONE 'UTC' AS date) - 1) THEN cast({_NOW} AT TIME ZONE 'UTC' AS date) - 1 ELSE max(event_date) END AS day FROM campaign_daily_stats")
def report_day(spark: SparkSession, d: str) -> DataFrame:
    return gold.report_day(_campaigns(spark, d), now())


def _lines_sql() -> str:
    change = lambda c: f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE CASE WHEN {c} >= 0 THEN '▲' ELSE '▼' END || printf('%+.1f%%', {c}) END"
    short = "CASE WHEN abs(value) >= 1e6 THEN printf('%.2fM', value / 1e6) WHEN abs(value) >= 1e3 THEN printf('%.1fk', value / 1e3) ELSE printf('%.0f', value) END"
    shown = f"CASE WHEN metric = 'cost' THEN '$' || format('{{:,}}', round(value)::bigint) WHEN metric IN ('ctr', 'cvr') THEN printf('%.2f%%', value * 100) WHEN metric = 'roas' THEN printf('%.2fx', value) ELSE {short} END"
    return f"SELECT metric, {shown} AS shown, {change('wow_pct')} AS wow, {change('mom_pct')} AS mom FROM ({_wow_sql()})"


@query(_lines_sql())
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return gold.report_lines(wow_mom_report(spark, d))


@query(f"WITH {_KPI} SELECT * FROM k WHERE event_date <= DATE '2024-01-07' ORDER BY event_date DESC LIMIT 7")
def recent_7_days(spark: SparkSession, d: str) -> DataFrame:
    return gold.recent_days(_kpis(spark, d), F.lit("2024-01-07").cast("date"), 7)


@query(f"WITH {_KPI} SELECT * FROM k WHERE event_date <= DATE '2024-01-09' ORDER BY event_date DESC LIMIT 30")
def trend_30_days(spark: SparkSession, d: str) -> DataFrame:
    return gold.recent_days(_kpis(spark, d), F.lit("2024-01-09").cast("date"), 30)


# --- generators ------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT *, row_number() OVER () AS r FROM processed_events WHERE event_type = 'click' AND source = 'criteo'),
 n(event_type, n) AS (VALUES ('request', 50), ('impression', 40), ('click', 1))
 SELECT event_type, coalesce(campaign_id, 0) AS campaign_id, sum(n)::bigint AS n_events, round(sum(CASE WHEN event_type IN ('request', 'impression') THEN 0.0 ELSE coalesce(cost, 0) * n END), 4) AS cost FROM (SELECT n.event_type, n.n, c.campaign_id, c.cost FROM c, n) GROUP BY ALL""")
def funnel_synthesis(spark: SparkSession, d: str) -> DataFrame:
    clicks = _events(spark, d).where("event_type = 'click' AND source = 'criteo'")
    e = generate.synthesise(clicks)
    return e.groupBy("event_type", "campaign_id").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("cost"), 4).alias("cost"))


def _drawn(name: str) -> str:
    return f"(('0x' || substr(md5('{name}/42/' || i), 1, 7))::bigint::double / 268435456.0)"


_STEPS = f"""a AS (SELECT i, cast(10000001 + floor({_drawn('campaign')} * 50) AS int) AS campaign_id, {_drawn('fill')} < 0.8 AS imp, {_drawn('ctr')} < 0.025 AS clk, {_drawn('cvr')} < 0.035 AS cnv FROM range(100000) t(i)),
 e AS (SELECT campaign_id, 'request' AS event_type FROM a UNION ALL SELECT campaign_id, 'impression' FROM a WHERE imp UNION ALL SELECT campaign_id, 'click' FROM a WHERE imp AND clk UNION ALL SELECT campaign_id, 'conversion' FROM a WHERE imp AND clk AND cnv)"""


@query(f"WITH {_STEPS} SELECT campaign_id, event_type, count(*) AS n_events FROM e GROUP BY ALL")
def generated_funnel(spark: SparkSession, d: str) -> DataFrame:
    return generate.random_funnel(spark, 100_000).groupBy("campaign_id", "event_type").agg(F.count(F.lit(1)).alias("n_events"))


def _u(name: str, lo: float, hi: float) -> str:
    return f"({lo}::double + (('0x' || substr(md5('{name}/' || campaign_id || '/' || strftime(event_date, '%Y-%m-%d')), 1, 7))::bigint)::double / 268435456.0::double * {hi - lo}::double)"


_HISTORY = f"""WITH d AS (SELECT i // 5 AS back, cast(90000001 + i % 5 AS int) AS campaign_id, DATE '2024-01-07' - (i // 5)::int AS event_date FROM range(175) t(i)),
 a AS (SELECT *, floor({_u('requests', 40000, 80000)} * CASE WHEN isodow(event_date) <= 5 THEN 1.0 ELSE 0.6 END::double * (1.0::double + (35 - back) * 0.004::double))::bigint AS requests FROM d),
 b AS (SELECT *, floor(requests * {_u('fill', 0.75, 0.85)})::bigint AS impressions FROM a), c AS (SELECT *, floor(impressions * {_u('ctr', 0.02, 0.03)})::bigint AS clicks FROM b),
 e AS (SELECT *, floor(clicks * {_u('cvr', 0.03, 0.04)})::bigint AS conversions, round(clicks * {_u('click price', 0.3, 0.8)}, 2) AS cost FROM c)
 SELECT campaign_id, event_date, requests, impressions, clicks, conversions, coalesce(round(impressions / nullif(requests, 0), 4), 0) AS fill_rate, coalesce(round(clicks / nullif(impressions, 0), 4), 0) AS ctr,
 coalesce(round(conversions / nullif(clicks, 0), 4), 0) AS cvr, cost, coalesce(round(cost / nullif(conversions, 0), 2), 0) AS cpa, coalesce(round(conversions * 10.0 / nullif(cost, 0), 2), 0) AS roas FROM e"""


@query(_HISTORY)
def synthetic_history(spark: SparkSession, d: str) -> DataFrame:
    return generate.history(spark, "2024-01-07", 35)


@query("SELECT event_date, count(*) AS cnt, round(sum(cost), 4) AS cost FROM campaign_daily_stats GROUP BY event_date")
def delete_synthetic(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, "gold.campaign_daily_stats", CAMPAIGN_DDL, ["event_date"])
    t.append(_campaigns(spark, d))
    t.append(generate.history(spark, "2024-01-07", 35).withColumn("updated_at", now()))
    t.delete_where(F.col("campaign_id") >= generate.SYNTHETIC_BASE)
    return t.scan().groupBy("event_date").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("cost"), 4).alias("cost"))


# --- metadata and maintenance ----------------------------------------------------------------------------------------


@query("SELECT count(*) AS files, coalesce(round(avg(file_size_in_bytes) / 1048576, 2), 0) AS avg_mb, sum(record_count)::bigint AS records FROM (SELECT DISTINCT * FROM click_files)")
def meta_file_stats(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "click_files").distinct()
    return f.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.round(F.avg("file_size_in_bytes") / 1048576, 2), F.lit(0.0)).alias("avg_mb"), F.sum("record_count").alias("records"))


@query("SELECT dt, hour, count(*) AS files, round(avg(file_size_in_bytes) / 1048576, 4) AS avg_mb, sum(record_count)::bigint AS records FROM (SELECT DISTINCT * FROM click_files) GROUP BY dt, hour ORDER BY files DESC, dt, hour LIMIT 20")
def meta_partition_files(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "click_files").distinct().groupBy("dt", "hour")
    f = f.agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("file_size_in_bytes") / 1048576, 4).alias("avg_mb"), F.sum("record_count").alias("records"))
    return f.orderBy(F.desc("files"), "dt", "hour").limit(20)


def _bronze_in_batches(spark: SparkSession, d: str) -> ManagedTable:
    t = _table(spark, "bronze.ad_clicks", BRONZE, ["dt"])
    a = load(spark, d, "ad_clicks")
    for k in range(6):
        t.append(a.where(F.pmod(F.hour("ingested_at"), F.lit(6)) == k))  # six batches that make up the whole table
    return t


_BATCH = "hour(ingested_at AT TIME ZONE 'UTC') % 6"


@query(f"SELECT row_number() OVER (ORDER BY k) AS version, 'append' AS operation, cast(n AS varchar) AS added, '0' AS deleted FROM (SELECT {_BATCH} AS k, count(*) AS n FROM ad_clicks GROUP BY 1)")
def meta_snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = _bronze_in_batches(spark, d).snapshots()
    return s.select("version", "operation", F.col("summary")["added-records"].alias("added"), F.col("summary")["deleted-records"].alias("deleted")).orderBy(F.desc("version")).limit(10)


@query(f"SELECT count(DISTINCT {_BATCH}) AS manifests, count(DISTINCT ({_BATCH}, dt))::bigint AS data_files FROM ad_clicks")
def meta_manifests(spark: SparkSession, d: str) -> DataFrame:
    return _bronze_in_batches(spark, d).manifests().agg(F.count(F.lit(1)).alias("manifests"), F.sum("data_files").alias("data_files"))


@query(f"SELECT dt, count(DISTINCT {_BATCH}) AS files, count(*)::bigint AS records, true AS sized FROM ad_clicks GROUP BY dt")
def meta_table_files(spark: SparkSession, d: str) -> DataFrame:
    """File statistics of a managed table, from its own metadata."""
    f = _bronze_in_batches(spark, d).files().groupBy(F.col("partition")["dt"].alias("dt"))
    return f.agg(F.count(F.lit(1)).alias("files"), F.sum("record_count").alias("records"), (F.min("file_size_in_bytes") > 0).alias("sized"))


@query("SELECT dt, count(*) AS cnt, count(DISTINCT (kafka_partition, kafka_offset, ingested_at)) AS messages FROM ad_clicks GROUP BY dt")
def compaction_lossless(spark: SparkSession, d: str) -> DataFrame:
    t = _bronze_in_batches(spark, d)
    maintenance.compact(t)
    return t.scan().groupBy("dt").agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("kafka_partition", "kafka_offset", "ingested_at").alias("messages"))


@query("SELECT 5::bigint AS expired_snapshots, 0::bigint AS deleted_files, 2::bigint AS kept")
def expire_result(spark: SparkSession, d: str) -> DataFrame:
    t = _bronze_in_batches(spark, d)
    maintenance.compact(t)
    r = maintenance.expire(t, 2**60, 2)
    return spark.createDataFrame([(r["expired_snapshots"], r["deleted_files"], len(t.versions()))], "expired_snapshots bigint, deleted_files bigint, kept bigint")


@query("SELECT 1::bigint AS deleted_orphans, count(*) AS rows_left FROM ad_clicks")
def orphan_result(spark: SparkSession, d: str) -> DataFrame:
    t = _bronze_in_batches(spark, d)
    t._stage(load(spark, d, "ad_clicks").where(F.col("dt") == "2024-01-03"))  # written, never committed
    r = maintenance.remove_orphans(t, 72, now_ms=2**42)
    return spark.createDataFrame([(r["deleted_orphans"], t.scan().count())], "deleted_orphans bigint, rows_left bigint")


@query(SQL["bronze_topic_counts"])
def stream_bronze_ingest(spark: SparkSession, d: str) -> DataFrame:
    landing = scratch(spark, "landing")
    for t in EVENT_TYPES:
        wire.records(spark, d, t).drop("ingested_at").write.mode("append").parquet(landing)
    tables = {bronze_table_of(topic_of(t)): _table(spark, f"bronze.{bronze_table_of(topic_of(t))}", BRONZE, BRONZE_PARTITION) for t in EVENT_TYPES}
    ingest.supervise(lambda: ingest.start(ingest.file_stream(spark, landing), tables, scratch(spark, "checkpoint"), every=None))
    parts = [t.scan().agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(n).alias("tbl"), "cnt") for n, t in tables.items()]
    return reduce(DataFrame.unionAll, parts)
