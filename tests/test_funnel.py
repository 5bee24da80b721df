"""Bronze, Silver, Gold, report and health on hand rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewell.plans import generate, gold, health, silver
from tidewell.schemas import SILVER, SILVER_COLUMNS, bronze_table_of, topic_of
from tidewell.sources import wire
from tidewell.table.managed import ManagedTable

RAW = "value string, ingested_at timestamp, kafka_partition int, kafka_offset bigint"
T = dt.datetime(2024, 1, 5, 10)


def AS_OF():  # noqa: N802 - built on use, as columns need a session
    return F.lit("2024-01-08 00:00:00").cast("timestamp")


def raw(spark, *values):
    return spark.createDataFrame([(json.dumps(v) if isinstance(v, dict) else v, T, 0, k) for k, v in enumerate(values)], RAW)


NATIVE = {"event_id": "e1", "event_type": "click", "source": "dummy", "auction_id": "a1", "campaign_id": 10000001, "banner_id": "10000001_300_1", "site_cat": "IAB1", "device_type": 1, "os": "android", "country": "KR", "uid": "u_0000001", "floor_price": 0.3, "bid_price": 0.45, "timestamp": 1700000000}
REPLAY = {"event_id": "e1", "event_type": "click", "source": "criteo", "auction_id": "a1", "campaign": 7, "uid": "42", "cost": 0.1, "timestamp": 10, "conversion": 0, "cat1": 1, "cat2": 2}


def test_topics():
    assert [topic_of(t) for t in ("request", "impression", "click", "conversion")] == ["ad-requests", "ad-impressions", "ad-clicks", "ad-conversions"]
    assert bronze_table_of("ad-clicks") == "ad_clicks"


def test_parse(spark):
    n = silver.parse_native(raw(spark, NATIVE)).first()
    assert (n["campaign_id"], n["cost"], n["conversion"], str(n["event_date"])) == (10000001, 0.45, 0, "2023-11-14")
    r = silver.parse_replay(raw(spark, REPLAY)).first()
    assert (r["campaign_id"], r["cost"], r["banner_id"], r["site_cat"], r["os"], str(r["event_date"])) == (7, 100.0, "7_1_2", "IAB2", None, "2024-01-01")
    part = silver.parse_replay(raw(spark, REPLAY | {"cat2": None}, REPLAY | {"cat1": -1}, REPLAY | {"cat1": None})).collect()
    assert [(p["banner_id"], p["site_cat"]) for p in part] == [("7_1", "IAB2"), ("7_-1_2", "IAB13"), ("7_2", None)]


def test_unknown_sources_and_broken_fields(spark):
    u = silver.unify(raw(spark, "{bad", NATIVE | {"source": "web"}, {k: v for k, v in NATIVE.items() if k != "source"}, NATIVE | {"campaign_id": "abc"}, NATIVE | {"campaign_id": 99999999999}, None, NATIVE | {"device_type": "x"}))
    assert sorted(((r["campaign_id"], r["device_type"]) for r in u.collect()), key=str) == [(10000001, None), (None, 1), (None, 1)]


ROW = "event_id string, event_type string, source string, auction_id string, campaign_id int, event_timestamp timestamp, event_date date, uid string, banner_id string, site_cat string, device_type int, os string, country string, cost double, conversion int, conversion_delay_sec bigint, updated_at timestamp"


def rows(spark, *specs):
    out = []
    for s in specs:
        r = {c: None for c in SILVER_COLUMNS} | {"event_id": "e", "event_type": "click", "source": "dummy", "campaign_id": 1, "uid": "u", "banner_id": "b", "cost": 1.0, "event_timestamp": T, "updated_at": T} | s
        if "event_date" not in s and r["event_timestamp"]:
            r["event_date"] = r["event_timestamp"].date()
        out.append(tuple(r[c] for c in SILVER_COLUMNS))
    return spark.createDataFrame(out, SILVER)


@pytest.mark.parametrize(
    ("spec", "reason"),
    [
        ({"event_id": None, "cost": -1.0}, "null_event_id"), ({"event_type": "view", "uid": None}, "bad_event_type"), ({"event_type": None}, "bad_event_type"), ({"campaign_id": None}, "null_campaign_id"), ({"uid": None}, "null_uid"),
        ({"cost": -0.01}, "negative_cost"), ({"cost": 0.0}, None), ({"cost": None}, None), ({"event_timestamp": None}, "timestamp_out_of_range"), ({"event_timestamp": dt.datetime(2019, 12, 31, 23, 59, 59)}, "timestamp_out_of_range"),
        ({"event_timestamp": dt.datetime(2024, 1, 9, 0, 0, 1)}, "timestamp_out_of_range"), ({"event_timestamp": dt.datetime(2020, 1, 1)}, None), ({"event_timestamp": dt.datetime(2024, 1, 9)}, None),
    ],
)
def test_first_failing_rule_counts(spark, spec, reason):
    assert silver.tag(rows(spark, spec), AS_OF()).first()["reject_reason"] == reason


def test_dedup_takes_the_latest(spark):
    e = rows(spark, {"cost": 1.0}, {"cost": 2.0, "updated_at": T + dt.timedelta(hours=1)}, {"event_id": "E", "cost": 0.5, "updated_at": T - dt.timedelta(hours=1)})
    assert [(r["event_id"], r["cost"]) for r in silver.dedup_latest(e, [F.desc("updated_at")]).collect()] == [("e", 2.0)]


def test_conversion_delay(spark):
    conv = lambda i, a, s: {"event_id": i, "event_type": "conversion", "auction_id": a, "event_timestamp": T + dt.timedelta(seconds=s)}
    e = rows(spark, {"event_id": "k", "auction_id": "a"}, {"event_id": "k2", "auction_id": "a", "event_timestamp": T + dt.timedelta(seconds=99)}, conv("c1", "a", 330), conv("c2", "a", -60), conv("c3", "none", 1), conv("c4", None, 1), conv("c5", "old", 10))
    known = rows(spark, {"event_id": "o", "auction_id": "old"})
    got = {r["event_id"]: r["conversion_delay_sec"] for r in silver.conversion_delay(e, known).collect()}
    assert got == {"k": None, "k2": None, "c1": 330, "c2": -60, "c3": None, "c4": None, "c5": 10}


def test_window_modes(spark):
    t = raw(spark, NATIVE).withColumn("dt", F.lit("2024-01-05")).withColumn("hour", F.lit(10))
    as_of = F.lit("2024-01-07 12:00:00").cast("timestamp")
    count = lambda **kw: silver.read_window([t, t], as_of, **kw).count()
    assert (count(window_days=2), count(window_days=1), count(window_days=0, lookback_hours=50), count(lookback_hours=49), count(hour=10), count(hour=9), count(hour=-1)) == (2, 0, 2, 0, 2, 0, 2)


def test_campaign_mart(spark):
    many = lambda c, t, n, **kw: [{"campaign_id": c, "event_type": t, "cost": 0.0} | kw] * n
    s = rows(spark, *many(1, "request", 4), *many(1, "impression", 3), *many(1, "click", 1, cost=1.5), *many(1, "click", 1, cost=0.5), *many(1, "conversion", 1, cost=9.0), *many(2, "request", 1), *many(3, "click", 1, cost=None))
    got = {r["campaign_id"]: tuple(r)[2:] for r in gold.campaign_daily(s).collect()}
    assert got[1] == (4, 3, 2, 1, 0.75, 0.666667, 0.5, 2.0, 2.0, 5.0)
    assert got[2] == (1, 0, 0, 0, 0.0, None, None, 0.0, None, None)
    assert got[3] == (0, 0, 1, 0, None, None, 0.0, None, None, None)


def test_banner_peak_hour(spark):
    imp = lambda h, b="b": {"event_type": "impression", "event_timestamp": dt.datetime(2024, 1, 5, h), "banner_id": b}
    s = rows(spark, imp(9), imp(9), imp(14), imp(14), imp(3), {"banner_id": "quiet"}, imp(5, None))
    got = {r["banner_id"]: (r["impressions"], r["clicks"], r["peak_hour"]) for r in gold.banner_daily(s).collect()}
    assert got == {"b": (5, 0, 9), "quiet": (0, 1, None), None: (1, 0, None)}


def stats(spark, *r):
    return spark.createDataFrame([(c, dt.date(2024, 1, d), *x) for c, d, *x in r], "campaign_id int, event_date date, requests bigint, impressions bigint, clicks bigint, conversions bigint, fill_rate double, ctr double, cvr double, cost double")


def test_violations_and_consistency(spark):
    c = stats(spark, (1, 1, 10, 9, 2, 1, 0.9, 0.2, 0.5, 3.0), (2, 1, 1, 2, 1, 1, 2.0, 0.5, 1.0, 0.5), (3, 1, 1, 1, 1, 1, None, None, None, None))
    assert [r["campaign_id"] for r in gold.funnel_violations(c).collect()] == [2] == [r["campaign_id"] for r in gold.ratio_violations(c).collect()]
    assert gold.cost_consistency(c, rows(spark, {"cost": 3.0}, {"cost": 0.25})).first()["diff"] == 0.25
    assert gold.cost_consistency(c.limit(0), rows(spark)).first()["diff"] == 0.0


def test_report(spark):
    c = stats(spark, (1, 1, 1, 1000, 0, 0, None, None, None, 0.0), (1, 8, 1, 1100, 10, 0, None, None, None, 5.0))
    k = gold.daily_kpis(gold.daily_rollup(c, AS_OF()))
    got = {r["metric"]: (r["value"], r["wow_pct"], r["mom_pct"]) for r in gold.wow_mom(k, F.lit("2024-01-08").cast("date")).collect()}
    assert got["impressions"] == (1100.0, 10.0, None) and got["cvr"][0] == 0.0 and got["clicks"][1] is None
    assert str(gold.report_day(c, AS_OF()).first()[0]) == "2024-01-08" and str(gold.report_day(c, F.lit("2024-01-02 06:00:00").cast("timestamp")).first()[0]) == "2024-01-01"
    assert gold.recent_days(k, F.lit("2024-01-08").cast("date"), 1).count() == 1


def test_synthesis(spark):
    clicks = spark.createDataFrame([("a", 7, "u", 2.0, 1), ("b", None, None, None, None)], "auction_id string, campaign_id int, uid string, cost double, conversion int")
    e = generate.synthesise(clicks)
    got = {(r["auction_id"], r["event_type"]): (r["n"], r["cost"]) for r in e.groupBy("auction_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).collect()}
    assert got == {("a", "request"): (50, 0.0), ("a", "impression"): (40, 0.0), ("a", "click"): (1, 2.0), ("a", "conversion"): (1, 2.0), ("b", "request"): (50, 0.0), ("b", "impression"): (40, 0.0), ("b", "click"): (1, 0.0)}
    assert e.select("event_id").distinct().count() == 183


def test_random_funnel_rates(spark):
    n = {r["event_type"]: r["count"] for r in generate.random_funnel(spark, 200_000).groupBy("event_type").count().collect()}
    assert n["request"] == 200_000 and abs(n["impression"] / n["request"] - 0.8) < 0.01 and abs(n["click"] / n["impression"] - 0.025) < 0.003


def test_history_is_healthy(spark):
    h = generate.history(spark, "2024-01-07", 20)
    assert h.count() == 100 and gold.funnel_violations(h).count() == 0 and gold.ratio_violations(h).count() == 0


def test_bronze_projection(spark):
    rec = spark.createDataFrame([(b"k", b"v", "ad-clicks", 1, 5, dt.datetime(2024, 1, 5, 23, 59, 59))], "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp")
    b = wire.project_bronze(rec).first()
    assert (b["key"], b["value"], b["kafka_offset"], b["dt"], b["hour"]) == ("k", "v", 5, "2024-01-05", 23)


def small_tables(spark, path, silver_rows):
    s = ManagedTable.create_if_not_exists(spark, f"{path}/s", SILVER, ["event_date"], name="silver")
    c = ManagedTable.create_if_not_exists(spark, f"{path}/c", "campaign_id int, event_date date, requests bigint, impressions bigint, clicks bigint, conversions bigint, fill_rate double, ctr double, cvr double, cost double, cpa double, roas double, updated_at timestamp", ["event_date"], name="campaigns")
    b = ManagedTable.create_if_not_exists(spark, f"{path}/b", "value string", name="bronze")
    s.append(silver_rows)
    return s, c, b


def test_health(spark, path):
    clean = rows(spark, {"event_type": "request"}, {"event_id": "f", "event_type": "impression"}, {"event_id": "g"})
    s, c, b = small_tables(spark, path, clean)
    c.append(gold.campaign_daily(s.scan()).withColumn("updated_at", F.lit(T)))
    near = F.lit(T + dt.timedelta(minutes=30)).cast("timestamp")
    r = health.report([b], s, {"campaigns": c}, near)
    got = {(x["check"], x["label"]): x["status"] for x in r.collect()}
    assert got[("freshness", "bronze")] == "WARN" and got[("freshness", "silver")] == "OK" and got[("duplicates", "silver")] == "OK" and got[("cost", "campaigns")] == "OK"
    assert not health.failed(r)
    assert health.report([b], s, {"campaigns": c}, F.lit(T + dt.timedelta(minutes=30, seconds=6)).cast("timestamp")).where("check = 'freshness' AND label = 'silver'").first()["status"] == "WARN"
    s.append(clean)
    assert health.failed(health.report([b], s, {"campaigns": c}, near))


def test_display(spark):
    from tidewell.functions import display

    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(display.short_number(F.lit(x))) for x in (1_500_000, 2345, 42, -1200)] == ["1.50M", "2.3k", "42", "-1.2k"]
    assert one(display.money(F.lit(1234.4))) == "$1,234" and one(display.percent(F.lit(0.0236))) == "2.36%"
    assert [one(display.change(F.lit(x).cast("double"))) for x in (12.34, -3.0, None)] == ["▲+12.3%", "▼-3.0%", "n/a"]
    assert one(display.padded(F.lit("노출"), 6)) == "  노출"
