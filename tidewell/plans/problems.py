"""Queries of the general data problems 1 to 3 and 5 to 7, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.ids import bare_id, message_id, spelled
from tidewell.operators import compaction, dedup_index, late_events, schema_drift, sessions, skew
from tidewell.operators.standing import standing_events
from tidewell.schemas import EVENT_TYPES, WIRE
from tidewell.session import materialise, scratch
from tidewell.sources.tables import load, spread
from tidewell.streaming import windows

SLICES = 3
FILE_OF_ROW = {"dt": "dt", "hour": "hour", "kafka_partition": "kafka_partition", "ingested_at": "committed_at"}


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "ad_clicks"), "kafka_partition", "kafka_offset", "ingested_at")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    events = standing_events(load(spark, d, "processed_events"), "event_timestamp", "uid", "event_type")
    return sessions.sessionize(events, "uid", "event_timestamp", "event_type", tuple(EVENT_TYPES))


def _punctuated(spark: SparkSession, d: str) -> DataFrame:
    events = late_events.arrivals(load(spark, d, "processed_events"), load(spark, d, "ad_clicks"), "event_timestamp", "event_type", "source")
    return late_events.punctuate(materialise(events, "arrivals"))


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compact(spark, load(spark, d, "click_files"), load(spark, d, "ad_clicks"), ["dt", "hour"], FILE_OF_ROW)


def _ingested(spark: SparkSession, d: str, table: str) -> tuple[DataFrame, DataFrame, tuple[Column, Column, Column]]:
    """The table, the result of its ingestion, and the identifier, batch and order it went by.

    The days of arrival go in three calls, one after the other: the second is searched in the persisted arrays of the
    first, and the third merges the runs of both.
    """
    df = load(spark, d, table)
    index = dedup_index.IdentifierIndex(spark, scratch(spark, f"index-{table}"), max_runs=SLICES)
    if table == "ad_clicks":
        by = message_id("value"), F.col("dt"), F.unix_micros("kafka_timestamp")
    else:
        by = bare_id("event_id"), F.to_date("updated_at"), F.unix_micros("updated_at")
    return df, index.ingest_slices(df, *by, slices=SLICES), by


def _indexed(spark: SparkSession, d: str, table: str) -> DataFrame:
    return _ingested(spark, d, table)[1]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_report(_messages(spark, d), WIRE).select("dt", "source", "change_kind", "field_name").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_report(_messages(spark, d), WIRE)


def p1_schemas(spark: SparkSession, d: str) -> DataFrame:
    """The folded schema of each day and source."""
    return schema_drift.day_schemas(_messages(spark, d), WIRE)


def p1_clicks(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.union_table(_messages(spark, d), WIRE, keep=("kafka_partition", "kafka_offset", "dt", "hour"))


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """How many messages fill each field of the click table, and how many it rejects."""
    t = schema_drift.union_table(_messages(spark, d), WIRE)
    names = list(dict.fromkeys(n for f in WIRE.values() for n in f))
    filled = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in names), F.when(F.col("reject_reason").isNotNull(), F.concat(F.lit("rejected: "), "reject_reason"))))
    return t.select("source", F.explode(filled).alias("field_name")).groupBy("source", "field_name").agg(F.count(F.lit(1)).alias("n_messages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("uid", "session_start", "session_end")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


def p2_stream(spark: SparkSession, d: str) -> DataFrame:
    """The sessions once more, from a stream with late events under a watermark."""
    events = standing_events(load(spark, d, "processed_events"), "event_timestamp", "uid", "event_type")
    return windows.drain_sessions(events)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(load(spark, d, "processed_events"), ("campaign_id", "banner_id")).select("key_column", "key_value")


def p3_campaigns(spark: SparkSession, d: str) -> DataFrame:
    return skew.funnel_by_key(load(spark, d, "processed_events"), "campaign_id")


def p3_banners(spark: SparkSession, d: str) -> DataFrame:
    return skew.funnel_by_key(load(spark, d, "processed_events"), "banner_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d).select("dt", "hour")


def p5_compacted(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    late = late_events.diverted(_punctuated(spark, d))
    return late.where(F.col("event_id").isNotNull()).select(spelled("event_id").alias("event_id"))


def p6_hourly(spark: SparkSession, d: str) -> DataFrame:
    return late_events.corrected_counts(_punctuated(spark, d), tuple(EVENT_TYPES))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [dedup_index.copies(_indexed(spark, d, t)).select(F.lit(t).alias("tbl"), spelled("id").alias("event_id")) for t in ("ad_clicks", "processed_events")]
    return parts[0].unionByName(parts[1])


def p7_clicks(spark: SparkSession, d: str) -> DataFrame:
    kept = dedup_index.kept(_indexed(spark, d, "ad_clicks"))
    return kept.select(spelled("id").alias("event_id"), F.col("batch").alias("dt"), F.col("first_at").alias("kafka_us"))


def p7_events(spark: SparkSession, d: str) -> DataFrame:
    kept = dedup_index.kept(_indexed(spark, d, "processed_events"))
    return kept.select(spelled("id").alias("event_id"), F.col("first_at").alias("updated_us"))


def p7_clicks_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each message once, whole, beside its identifier; all messages without one."""
    df, result, by = _ingested(spark, d, "ad_clicks")
    rows = dedup_index.kept_rows(df, result, *by, ties=("kafka_partition", "kafka_offset"))
    return rows.select(spelled("__id").alias("event_id"), *df.columns)


def p7_events_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each event once, by the whole row that stands for it; all rows without identifier."""
    df, result, by = _ingested(spark, d, "processed_events")
    rows = dedup_index.kept_rows(df, result, *by, ties=("event_timestamp",))
    return rows.withColumn("event_id", spelled("__id")).select(df.columns)


def p7_kept_sums(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the kept rows of both tables, which tell whether the right ones were kept."""
    us = lambda c: F.sum(F.pmod(F.unix_micros(c), F.lit(1_000_003)))
    e = p7_events_rows(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count("event_id").alias("n_ids"), us("updated_at").alias("times"), F.sum(F.length("event_type") + F.coalesce("conversion_delay_sec", F.lit(0))).alias("content"))
    m = p7_clicks_rows(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count("event_id").alias("n_ids"), us("kafka_timestamp").alias("times"), F.sum(F.length("value") + F.col("kafka_offset")).alias("content"))
    return m.select(F.lit("ad_clicks").alias("tbl"), "*").unionByName(e.select(F.lit("processed_events").alias("tbl"), "*"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_schemas, p1_clicks, p1_filled, p2_found, p2_sessions, p2_stream, p3_found, p3_campaigns, p3_banners, p5_found, p5_compacted, p6_found, p6_hourly, p7_found, p7_clicks, p7_events, p7_clicks_rows, p7_events_rows, p7_kept_sums)}

_BARE = "nullif(lower(trim(replace(event_id, '-', ''))), '')"
_UUID = "substr({0},1,8)||'-'||substr({0},9,4)||'-'||substr({0},13,4)||'-'||substr({0},17,4)||'-'||substr({0},21,12)"
_MESSAGES = """m AS (SELECT *, CASE WHEN json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT'
  THEN nullif(lower(replace(json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.event_id'), '-', '')), '') END AS id FROM ad_clicks)"""
_STANDING = f"""e AS (SELECT *, {_BARE} AS id FROM processed_events),
 s AS (SELECT * FROM e WHERE id IS NULL UNION ALL
       SELECT * FROM (SELECT * FROM e WHERE id IS NOT NULL
                      QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at, event_timestamp NULLS FIRST) = 1))"""
_SESSIONS = f"""WITH {_STANDING},
 u AS (SELECT uid, event_type, epoch_us(event_timestamp) AS us FROM s WHERE uid IS NOT NULL AND event_timestamp IS NOT NULL),
 g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY uid ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM u),
 n AS (SELECT *, sum(opens) OVER (PARTITION BY uid ORDER BY us, opens DESC ROWS UNBOUNDED PRECEDING) AS k FROM g),
 r AS (SELECT uid, k, min(us) // 1000000 AS session_start, max(us) // 1000000 AS session_end, count(*) AS n_events,
  count(*) FILTER (event_type = 'request') AS n_request, count(*) FILTER (event_type = 'impression') AS n_impression,
  count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'conversion') AS n_conversion,
  count(*) FILTER (coalesce(event_type, '') NOT IN ('request', 'impression', 'click', 'conversion')) AS n_other FROM n GROUP BY uid, k)"""


def _funnel_sql(key: str) -> str:
    return f"""SELECT cast({key} AS varchar) AS key_value, count(*) FILTER (event_type = 'request') AS requests,
 count(*) FILTER (event_type = 'impression') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
 count(*) FILTER (event_type = 'conversion') AS conversions, count(*) AS n_rows,
 round(sum(CASE WHEN event_type = 'click' THEN coalesce(cost, 0) ELSE 0.0 END), 4) AS cost FROM processed_events GROUP BY {key}"""


_ARRIVAL = f"""WITH {_MESSAGES}, {_STANDING},
 k AS (SELECT id, min(kafka_timestamp) AS sent FROM m WHERE id IS NOT NULL GROUP BY id),
 f AS (SELECT id, min(updated_at) AS first FROM e WHERE id IS NOT NULL GROUP BY id),
 a AS (SELECT s.id, s.source, s.event_type, s.event_timestamp, coalesce(k.sent, f.first, s.updated_at) AS arrival
       FROM s LEFT JOIN k ON s.id = k.id LEFT JOIN f ON s.id = f.id WHERE s.event_timestamp IS NOT NULL),
 b AS (SELECT *, epoch_us(event_timestamp) // 3600000000 * 3600 AS period_start,
       epoch_us(arrival) - (epoch_us(event_timestamp) // 3600000000 + 1) * 3600000000 AS delay_us FROM a)"""

_RENAMED = {
    "dummy": {"domain": "site_domain", "bidPrice": "bid_price", "slot": "banner_pos", "campaignId": "campaign_id", "event_time": "timestamp", "user_id": "uid", "operating_system": "os"},
    "criteo": {"campaign_id": "campaign", "t_rel": "timestamp", "cpc": "cost", "user": "uid"},
}


def _drift_sql() -> str:
    rows = []
    for src, fields in WIRE.items():
        for f, t in fields.items():
            rows.append(f"('{src}', '{f}', '{schema_drift.JSON_OF[t]}')")
    moved = [f"('{s}', '{new}', '{old}')" for s, m in _RENAMED.items() for new, old in m.items()]
    kinds = "CASE json_type(j, '$.\"' || k || '\"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END"
    return f"""WITH decl(source, name, kind) AS (VALUES {', '.join(rows)}), moved(source, new, old) AS (VALUES {', '.join(moved)}),
 v AS (SELECT row_number() OVER () AS r, dt, CASE WHEN json_valid(value) THEN value END::json AS j FROM ad_clicks),
 o AS (SELECT r, dt, j, json_extract_string(j, '$.source') AS source FROM v WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.source') = 'VARCHAR'),
 w AS (SELECT * FROM o WHERE source IN ('dummy', 'criteo')),
 keys AS (SELECT r, dt, source, k, {kinds} AS kind FROM (SELECT *, unnest(json_keys(j)) AS k FROM w)),
 gone AS (SELECT w.r, w.dt, w.source, decl.name FROM w JOIN decl USING (source) LEFT JOIN keys ON keys.r = w.r AND keys.k = decl.name WHERE keys.k IS NULL),
 ren AS (SELECT gone.r, gone.dt, gone.source, gone.name, moved.new FROM gone JOIN moved ON moved.source = gone.source AND moved.old = gone.name JOIN keys ON keys.r = gone.r AND keys.k = moved.new
   UNION ALL SELECT gone.r, gone.dt, gone.source, gone.name, 'geo' FROM gone JOIN w ON w.r = gone.r WHERE gone.source = 'dummy' AND gone.name = 'country' AND json_exists(w.j, '$.geo.country')),
 every AS (SELECT r, dt, source, 'renamed' AS change_kind, name AS field_name, CASE new WHEN 'geo' THEN 'geo.country' ELSE new END AS found_as FROM ren
 UNION ALL SELECT r, dt, source, 'removed', name, NULL FROM gone WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.r = gone.r AND ren.name = gone.name)
 UNION ALL SELECT r, dt, source, 'added', k, NULL FROM keys WHERE NOT EXISTS (SELECT 1 FROM decl WHERE decl.source = keys.source AND decl.name = keys.k) AND NOT EXISTS (SELECT 1 FROM ren WHERE ren.r = keys.r AND ren.new = keys.k)
 UNION ALL SELECT keys.r, keys.dt, keys.source, 'retyped', k, keys.kind FROM keys JOIN decl ON decl.source = keys.source AND decl.name = keys.k WHERE keys.kind <> decl.kind AND keys.kind <> 'null')"""


_FILES = """f AS (SELECT DISTINCT file_path, dt, hour, kafka_partition, file_size_in_bytes, committed_at FROM click_files),
 h AS (SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM ad_clicks a WHERE a.dt = f.dt AND a.hour = f.hour AND a.kafka_partition = f.kafka_partition AND a.ingested_at = f.committed_at)),
 c AS (SELECT dt, hour FROM h GROUP BY dt, hour HAVING count(*) > 5 AND avg(file_size_in_bytes) < 16384)"""



def _hourly_sql() -> str:
    one = {k: f"event_type = '{k}'" for k in EVENT_TYPES} | {"other": f"coalesce(event_type, '') NOT IN ({', '.join(repr(k) for k in EVENT_TYPES)})"}
    wait = "coalesce(delay_us, 0)"
    counts = [f"count(*) FILTER ({c} AND {wait} <= 0) AS first_{k}, count(*) FILTER ({c} AND {wait} <= 86400000000) AS n_{k}" for k, c in one.items()]
    return f"""{_ARRIVAL}, q AS (SELECT DISTINCT coalesce(source, '') AS src, epoch_us(arrival) AS at FROM b WHERE arrival IS NOT NULL),
 x AS (SELECT period_start, src, (period_start + 90000) * 1000000 AS bound FROM (SELECT DISTINCT period_start FROM b), (SELECT DISTINCT coalesce(source, '') AS src FROM b)),
 y AS (SELECT x.period_start, x.src, x.bound, q.at AS passed FROM x ASOF LEFT JOIN q ON q.src = x.src AND q.at > x.bound),
 z AS (SELECT period_start, max(CASE WHEN passed - bound <= 21600000000 THEN passed ELSE bound + 21600000000 END) AS closed_us, count(*) FILTER (passed - bound <= 21600000000) AS active_sources FROM y GROUP BY period_start)
 SELECT period_start, {', '.join(counts)}, count(*) FILTER ({wait} > 0 AND {wait} <= 86400000000) AS corrections, count(*) FILTER ({wait} > 86400000000) AS n_diverted,
  count(*) FILTER ({wait} > 86400000000 AND epoch_us(arrival) >= closed_us) AS n_after_close, any_value(closed_us) // 1000000 AS closed_at, any_value(active_sources) AS active_sources FROM b JOIN z USING (period_start) GROUP BY period_start"""


SQL = {
    "p1_found": f"{_drift_sql()} SELECT DISTINCT dt, source, change_kind, field_name FROM every",
    "p1_report": f"{_drift_sql()} SELECT dt, source, change_kind, field_name, found_as, count(DISTINCT r) AS n_messages FROM every GROUP BY ALL",
    "p1_schemas": f"""{_drift_sql()} SELECT dt, source, k AS field_name, CASE WHEN count(DISTINCT nullif(keys.kind, 'null')) > 1 THEN 'string' ELSE coalesce(max(nullif(keys.kind, 'null')), 'null') END AS json_type
 FROM keys WHERE EXISTS (SELECT 1 FROM decl WHERE decl.source = keys.source AND decl.name = keys.k) GROUP BY dt, source, k""",
    "p1_filled": f"""{_drift_sql()}, own AS (SELECT keys.r, keys.source, k AS name FROM keys JOIN decl ON decl.source = keys.source AND decl.name = keys.k WHERE keys.kind <> 'null'
  UNION SELECT ren.r, ren.source, ren.name FROM ren JOIN keys ON keys.r = ren.r AND keys.k = ren.new WHERE keys.kind <> 'null')
 SELECT source, name AS field_name, count(*) AS n_messages FROM own GROUP BY source, name
 UNION ALL SELECT NULL, CASE WHEN json_type(j) = 'OBJECT' THEN 'rejected: undeclared source' ELSE 'rejected: broken' END, count(*) FROM v WHERE r NOT IN (SELECT r FROM w) GROUP BY 2""",
    "p2_found": f"{_SESSIONS} SELECT uid, session_start, session_end FROM r",
    "p2_sessions": f"{_SESSIONS} SELECT uid, session_start, session_end, session_end - session_start AS duration_sec, n_events, n_request, n_impression, n_click, n_conversion, n_other FROM r",
    "p2_stream": f"{_SESSIONS} SELECT uid, session_start, session_end, n_events FROM r",
    "p3_found": " UNION ALL ".join(
        f"SELECT '{k}' AS key_column, cast({k} AS varchar) AS key_value FROM processed_events WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 0.02 * (SELECT count(*) FROM processed_events)"
        for k in ("campaign_id", "banner_id")
    ),
    "p3_campaigns": _funnel_sql("campaign_id"),
    "p3_banners": _funnel_sql("banner_id"),
    "p5_found": f"WITH {_FILES} SELECT dt, hour FROM c",
    "p5_compacted": f"""WITH {_FILES}, b AS (SELECT dt, hour, count(*) AS files_before FROM h GROUP BY dt, hour), r AS (SELECT dt, hour, count(*) AS n_records FROM ad_clicks GROUP BY dt, hour)
 SELECT dt, hour, files_before, 1::bigint AS files_after, n_records FROM c JOIN b USING (dt, hour) JOIN r USING (dt, hour)""",
    "p6_found": f"{_ARRIVAL} SELECT {_UUID.format('id')} AS event_id FROM b WHERE id IS NOT NULL AND delay_us > 86400000000",
    "p6_hourly": _hourly_sql(),
    "p7_found": f"""WITH {_MESSAGES}, e AS (SELECT {_BARE} AS id FROM processed_events)
 SELECT 'ad_clicks' AS tbl, {_UUID.format('id')} AS event_id FROM m WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'processed_events', {_UUID.format('id')} FROM e WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""",
    "p7_clicks": f"""WITH {_MESSAGES} SELECT {_UUID.format('id')} AS event_id, min(dt) AS dt, min(epoch_us(kafka_timestamp)) AS kafka_us FROM m WHERE id IS NOT NULL GROUP BY id""",
    "p7_kept_sums": f"""WITH {_MESSAGES}, e AS (SELECT *, {_BARE} AS id FROM processed_events),
 a AS (SELECT * FROM m WHERE id IS NULL UNION ALL (SELECT * FROM m WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY kafka_timestamp, kafka_partition NULLS FIRST, kafka_offset NULLS FIRST) = 1)),
 b AS (SELECT * FROM e WHERE id IS NULL UNION ALL (SELECT * FROM e WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at, event_timestamp NULLS FIRST, event_id, event_type) = 1))
 SELECT 'ad_clicks' AS tbl, count(*) AS n_rows, count(id) AS n_ids, sum(epoch_us(kafka_timestamp) % 1000003)::bigint AS times, sum(length(value) + kafka_offset)::bigint AS content FROM a
 UNION ALL SELECT 'processed_events', count(*), count(id), sum(epoch_us(updated_at) % 1000003)::bigint, sum(length(event_type) + coalesce(conversion_delay_sec, 0))::bigint FROM b""",
    "p7_events": f"""WITH e AS (SELECT {_BARE} AS id, updated_at FROM processed_events) SELECT {_UUID.format('id')} AS event_id, min(epoch_us(updated_at)) AS updated_us FROM e WHERE id IS NOT NULL GROUP BY id""",
}
