"""The operators of problems 1 to 7 on small cases: nulls, ties, repeats, empty tables, clashing names."""

import datetime as dt
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions.ids import bare_id, json_object, message_id, spelled
from tidewell.operators import compaction, dedup_index, late_events, schema_drift, sessions, skew
from tidewell.operators.standing import standing_events
from tidewell.schemas import WIRE
from tidewell.table.files import CommitConflict, walk

UUID = "8f52ae3a-038b-46b5-bfa4-112ec047145e"
T0 = dt.datetime(2024, 1, 2, 10)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


EVENTS = "event_id string, event_type string, source string, campaign_id int, banner_id string, uid string, event_timestamp timestamp, event_date date, cost double, updated_at timestamp"


def events(spark, *rows):
    full = []
    for r in rows:
        r = {"event_id": None, "event_type": "click", "source": "dummy", "campaign_id": 1, "banner_id": "b", "uid": "u", "event_timestamp": at(0), "cost": 1.0, "updated_at": at(60)} | r
        r["event_date"] = r["event_timestamp"].date() if r["event_timestamp"] else None
        full.append(tuple(r[c.split()[0]] for c in EVENTS.split(", ")))
    return spark.createDataFrame(full, EVENTS)


# --- identifiers ---


def test_identifiers(spark):
    df = spark.createDataFrame([(UUID,), (UUID.upper(),), (UUID.replace("-", ""),), (None,), ("  ",), ("Odd-One",)], "i string")
    got = [r[0] for r in df.select(spelled(bare_id("i"))).collect()]
    assert got == [UUID, UUID, UUID, None, None, "oddone"]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ('{"event_id": "AB-c"}', "abc"), (' \n{"event_id": "x"} ', "x"), ('{"event_id": null}', None), ('{"x": {"event_id": "n"}}', None), ('{"event_id": "x"', None),
        ('{"event_id": "x"} tail', None), ('{"event_id": "x"},{}', None), ('["event_id"]', None), ('"{\\"event_id\\""', None), ("", None), (None, None), ("{'event_id': 'x'}", None), ('{"event_id": "x", "source": "web"}', "x"),
    ],
)
def test_message_identifier(spark, value, want):
    assert spark.createDataFrame([(value,)], "value string").select(message_id("value")).first()[0] == want


def test_json_object_empty(spark):
    assert spark.createDataFrame([], "value string").select(json_object("value")).count() == 0


def test_standing_row_is_the_earliest(spark):
    df = events(spark, {"event_id": UUID, "cost": 2.0, "updated_at": at(200)}, {"event_id": UUID.upper(), "cost": 1.0, "updated_at": at(100)}, {"event_id": UUID, "cost": 9.0, "updated_at": None}, {}, {})
    got = sorted(standing_events(df, "cost").select("event_id", "cost").collect(), key=str)
    assert [(r[0], r[1]) for r in got] == [(UUID.replace("-", ""), 1.0), (None, 1.0), (None, 1.0)]


# --- 1 ---


def native(**kw):
    base = {
        "event_id": UUID, "event_type": "click", "source": "dummy", "auction_id": "a", "campaign_id": 10000001, "banner_id": "10000001_300_1", "banner_w": 300, "banner_h": 250, "banner_pos": 1,
        "site_domain": "news.example", "site_cat": "IAB1", "device_type": 1, "os": "android", "country": "KR", "uid": "u_1", "floor_price": 0.3, "bid_price": 0.45, "timestamp": 1704190000, "produced_at": "2024-01-02T10:00:00+00:00",
    }
    base |= kw
    return {k: v for k, v in base.items() if v is not ...}


def messages(spark, *values):
    return spark.createDataFrame([("2024-01-02", v if isinstance(v, str) or v is None else json.dumps(v)) for v in values], "dt string, value string")


def found(spark, *values):
    r = schema_drift.drift_report(messages(spark, *values), WIRE)
    return {(x["change_kind"], x["field_name"]) for x in r.collect()}


def test_drift_kinds(spark):
    many = [native(bid_price=round(0.2 + i / 100, 4), site_domain=f"s{i % 7}.example", uid=f"u_{i}") for i in range(200)]
    moved = [{k if k != "bid_price" else "bidPrice": v for k, v in m.items()} for m in many[:60]]
    nested = [native(country=..., geo={"country": "KR"}) for _ in range(30)]
    got = found(spark, *many, *moved, *nested, native(os=...), native(banner_w="300px"), native(exp={"arm": "a"}), native(uid=None), native(consent=None), "{broken", '"text"', None, "", {"source": "web", "x": 1}, [1])
    assert got == {("renamed", "bid_price"), ("renamed", "country"), ("removed", "os"), ("retyped", "banner_w"), ("added", "exp"), ("added", "consent")}


def test_drift_nothing(spark):
    assert found(spark) == set()
    assert found(spark, native(), None) == set()


def test_drift_is_alike_at_every_size(spark):
    few = [native(bid_price=round(0.2 + i / 100, 4), site_domain=f"s{i % 7}.example", uid=f"u_{i}") for i in range(60)]
    few += [{k if k != "bid_price" else "bidPrice": v for k, v in m.items()} for m in few[:3]] + [native(country=..., geo={"country": "KR"}), native(os=..., ad_format="reel"), native(banner_h=..., viewable_ms=2198)]
    want = {("renamed", "bid_price"), ("renamed", "country"), ("removed", "os"), ("added", "ad_format"), ("removed", "banner_h"), ("added", "viewable_ms")}
    assert found(spark, *few) == want == found(spark, *(few * 40))


def test_drift_of_names_without_number(spark):
    odd = [native(os=..., seen={f"k{i}": i, "x": [1]}, **{f"id{i}": f"v{i}"}) for i in range(150)]
    got = found(spark, *[native() for _ in range(20)], *odd)
    assert got == {("removed", "os"), ("added", "seen")} | {("added", f"id{i}") for i in range(150)}


def test_day_schemas(spark):
    df = messages(spark, native(os=None, banner_w=1), native(os=None, banner_w="x", site_cat=["a"]), native(os=None, banner_h=True), "{broken").withColumn("n", F.lit(1))
    got = {r["field_name"]: r["json_type"] for r in schema_drift.day_schemas(df, WIRE).collect()}
    assert (got["os"], got["banner_w"], got["site_cat"], got["banner_h"], got["cost"] if "cost" in got else None) == ("null", "string", "string", "string", None)
    assert got["bid_price"] == got["campaign_id"] == "number" and len(got) == len(WIRE["dummy"])


def test_union_table_keeps_content(spark):
    df = messages(spark, native(), native(banner_w="300px", site_cat=["IAB1", "IAB2"]), native(campaign_id=5.5)).withColumns({"uid": F.lit("mine"), "v": F.lit(1), "names": F.lit(2)})
    t = schema_drift.union_table(df, WIRE, keep=("dt", "uid", "v", "names"))
    assert {tuple(r) for r in t.select("v", "names").collect()} == {(1, 2)}
    assert dict(t.dtypes)["banner_w"] == "string" and dict(t.dtypes)["banner_h"] == "int"
    rows = {(r["banner_w"], r["site_cat"], r["msg_uid"]) for r in t.collect()}
    assert rows == {("300", "IAB1", "mine"), ("300px", '["IAB1","IAB2"]', "mine")}


def test_union_table_loses_nothing(spark):
    many = [native(bid_price=round(0.2 + i / 100, 4), uid=f"u_{i}") for i in range(200)]
    moved = [{k if k != "bid_price" else "bidPrice": v for k, v in m.items()} for m in many[:60]]
    odd = [
        native(campaign_id=5.5, banner_w=2**31, timestamp=2**53 + 1, floor_price=10**25, exp={"arm": "a"}, retry="5"), native(consent=None, retry=5),
        {k: v for k, v in native(bidPrice="free").items() if k != "bid_price"}, native(bidPrice=7),
    ]
    bad = ["{broken", None, '{"source": "web", "x": 1}', '{"source": 5}', "[1]", '{"source": "dummy", "uid": "a", "uid": "b"}']
    df = messages(spark, *many, *moved, *odd, *bad).withColumn("rest", F.lit("r"))
    t = schema_drift.union_table(df, WIRE, keep=("rest",))
    types = dict(t.dtypes)
    assert (types["campaign_id"], types["banner_w"], types["banner_h"], types["timestamp"], types["floor_price"], types["bid_price"]) == ("double", "bigint", "int", "bigint", "string", "string")
    rows = t.collect()
    assert len(rows) == len(many) + len(moved) + len(odd) + len(bad) and {r["msg_rest"] for r in rows} == {"r"}
    first = next(r for r in rows if r["campaign_id"] == 5.5)
    assert (first["banner_w"], first["timestamp"], first["floor_price"]) == (2**31, 2**53 + 1, str(10**25))
    rest = Counter(tuple(sorted(r["rest"].items())) for r in rows if r["rest"])
    assert rest == Counter({(("exp", '{"arm":"a"}'), ("retry", '"5"')): 1, (("consent", "null"), ("retry", "5")): 1, (("bidPrice", "7"),): 1})
    assert "free" in {r["bid_price"] for r in rows}
    why = Counter((r["reject_reason"], r["reject_value"]) for r in rows if r["reject_reason"])
    assert why == Counter((("undeclared source" if v in (bad[2], bad[3]) else "broken"), v) for v in bad)
    assert all(r["reject_value"] is None for r in rows if not r["reject_reason"])


def test_union_table_takes_promoted_types(spark):
    t = schema_drift.union_table(messages(spark, native(os=True, site_cat=["IAB1", 2], banner_w=1), native(os=False, site_cat=..., banner_w=True)), WIRE)
    types = dict(t.dtypes)
    assert (types["os"], types["site_cat"], types["banner_w"]) == ("boolean", "array<variant>", "string")
    rows = t.select("os", F.to_json(F.struct("site_cat")), "banner_w").collect()
    assert {tuple(r) for r in rows} == {(True, '{"site_cat":["IAB1",2]}', "1"), (False, "{}", "true")}


def test_parquet_drift(spark, tmp_path):
    tables = [
        pa.table({"a": pa.array([1, 2], pa.int32()), "b": ["x", "y"]}),
        pa.table({"a": pa.array([3], pa.int64()), "b": ["z"], "c": pa.array([1.5])}),
        pa.table({"a": pa.array(["t"]), "bee": ["q"]}),
    ]
    paths = []
    for k, t in enumerate(tables):
        pq.write_table(t, f"{tmp_path}/{k}.parquet")
        paths.append(f"file://{tmp_path}/{k}.parquet")
    table, log = schema_drift.read_drifting_parquet(spark, paths, {"bee": "b"})
    assert sorted(map(tuple, table.select("a", "b", "c").collect()), key=str) == [("1", "x", None), ("2", "y", None), ("3", "z", 1.5), ("t", "q", None)]
    assert [(r["seq"], r["change"], r["name"]) for r in log.collect()] == [(1, "added", "c"), (1, "retyped", "a"), (2, "removed", "c"), (2, "renamed", "b"), (2, "retyped", "a")]


@given(st.lists(st.sampled_from(list(schema_drift.SPARK_OF)), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_lattice_is_order_free(types):
    from functools import reduce

    fold = lambda t: reduce(schema_drift.widen, t)
    assert fold(types) == fold(types[::-1]) == fold(sorted(types)) == fold(types + types)


# --- 2 ---


def brute_sessions(rows, gap):
    by = defaultdict(list)
    for u, t in rows:
        if u is not None and t is not None:
            by[u].append(t)
    out = []
    for u, ts in by.items():
        ts.sort()
        start = last = ts[0]
        n = 0
        for t in ts:
            if t - last > gap:
                out.append((u, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((u, start, last, n))
    return sorted(out)


def test_sessions_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-4000, 200000, 1)])) for _ in range(1500)]
    rows += [("edge", 0), ("edge", 1800), ("edge", 3601), ("edge", 3601)] + [("hot", t) for t in range(0, 90000, 7)]
    df = spark.createDataFrame(rows, "uid string, s bigint").select("uid", F.timestamp_seconds("s").alias("t"), F.lit("x").alias("k"), F.lit("x").alias("slot"))
    got = sorted((r["uid"], r["session_start"], r["session_end"], r["n_events"]) for r in sessions.sessionize(df, "uid", "t").collect())
    assert got == brute_sessions(rows, 1800)


def test_sessions_kinds_and_micros(spark):
    df = spark.createDataFrame([("u", "click", 0), ("u", None, 1_800_000_000), ("u", "odd", 3_600_000_001), ("u", "click", 3_600_000_001)], "uid string, k string, us bigint").withColumn("t", F.timestamp_micros("us"))
    got = sorted((r["session_start"], r["n_events"], r["n_click"], r["n_other"], r["duration_sec"]) for r in sessions.sessionize(df, "uid", "t", "k", ("click",)).collect())
    assert got == [(0, 2, 1, 1, 1800), (3600, 2, 1, 1, 0)]
    assert sessions.sessionize(df.limit(0), "uid", "t", "k", ("click",)).count() == 0


# --- 3 ---


def test_salted_aggregate_equals_plain(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + [None, "a", "b", "c"]), rng.random()) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("key_value", F.lit(1)).repartition(3)
    got = {r["key_value"]: (r["n"], round(r["s"], 6)) for r in skew.salted_aggregate(df, "k", {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}).collect()}
    want = defaultdict(lambda: [0, 0.0])
    for k, v in rows:
        want[k][0] += 1
        want[k][1] += v
    assert got == {k: (n, round(s, 6)) for k, (n, s) in want.items()}


def test_heavy_keys(spark):
    rows = [{"campaign_id": 1, "banner_id": "x"}] * 97 + [{"campaign_id": 2, "banner_id": None}] * 2 + [{"campaign_id": None, "banner_id": "y"}]
    got = {(r["key_column"], r["key_value"]) for r in skew.heavy_keys(events(spark, *rows), ("campaign_id", "banner_id")).collect()}
    assert got == {("campaign_id", "1"), ("banner_id", "x")}  # two of a hundred isn't more than 2 %
    assert skew.heavy_keys(events(spark), ("campaign_id",)).count() == 0


def test_funnel_by_key(spark):
    df = events(spark, {"event_type": "request"}, {"cost": None}, {"cost": 2.5}, {"event_type": None, "campaign_id": None}, {"event_type": "odd"})
    got = {r["key_value"]: (r["requests"], r["clicks"], r["n_rows"], r["cost"]) for r in skew.funnel_by_key(df, "campaign_id").collect()}
    assert got == {"1": (1, 2, 4, 2.5), None: (0, 0, 1, 0.0)}


# --- 5 ---


@given(st.lists(st.integers(0, 120), max_size=60))
@settings(max_examples=150, deadline=None)
def test_first_fit_decreasing(sizes):
    bins = compaction.first_fit_decreasing(np.array(sizes, dtype=np.int64), 100)
    load = Counter()
    for s, b in zip(sizes, bins):
        load[b] += min(s, 100)
    assert all(x <= 100 for x in load.values())
    # the plain algorithm gives the same bins
    free, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = min(sizes[i], 100)
        k = next((k for k, f in enumerate(free) if f >= s), None)
        if k is None:
            free.append(100)
            k = len(free) - 1
        free[k] -= s
        want[i] = k
    assert list(bins) == [want[i] for i in range(len(sizes))]


LISTING = "file_path string, dt string, hour int, kafka_partition int, record_count bigint, file_size_in_bytes bigint, committed_at timestamp"
CLICKS = "key string, value string, dt string, hour int, kafka_partition int, ingested_at timestamp"
FILE_OF_ROW = {"dt": "dt", "hour": "hour", "kafka_partition": "kafka_partition", "ingested_at": "committed_at"}


def listing_and_rows(spark):
    files, rows = [], []
    for hour, n in ((1, 7), (2, 5), (3, 9)):
        for k in range(n):
            size = 900_000 if hour == 3 else 100 + k
            files.append((f"f{hour}-{k}", "2024-01-02", hour, k % 3, 2, size, at(k)))
            rows += [("k", None if k == 1 else f"v{k}", "2024-01-02", hour, k % 3, at(k))] * 2
    files += [files[0], ("empty", "2024-01-02", 2, 0, 0, 50, at(500)), ("lost", "2024-01-02", 2, 0, 3, 50, at(501)), (None, "2024-01-02", 2, 0, 3, 50, at(0))]
    return spark.createDataFrame(files, LISTING), spark.createDataFrame(rows, CLICKS)


def test_compaction(spark, path):
    listing, rows = listing_and_rows(spark)
    got = compaction.compact(spark, listing, rows, ["dt", "hour"], FILE_OF_ROW, root=path).collect()
    assert [(r["hour"], r["files_before"], r["files_after"], r["n_records"]) for r in got] == [(1, 7, 1, 14)]
    live = compaction.live_files(spark, path).collect()
    new = [r["file_path"] for r in live if r["rewritten"]]
    written = spark.read.option("basePath", new[0].rpartition("/dt=")[0]).schema(rows.schema).parquet(*new).select(rows.columns)
    assert Counter(written.collect()) == Counter(rows.where("hour = 1").collect())
    # every live file of the table is in the committed manifest, once
    assert sorted(r["file_path"] for r in live if not r["rewritten"]) == sorted(f"f{h}-{k}" for h, n in ((2, 5), (3, 9)) for k in range(n))
    assert sum(r["records"] for r in live) == rows.count()
    with pytest.raises(CommitConflict):
        compaction.compact(spark, listing, rows, ["dt", "hour"], FILE_OF_ROW, root=path)  # taken
    assert {r["file_path"] for r in compaction.live_files(spark, path).collect()} == {r["file_path"] for r in live}


def test_compaction_of_files_that_share_their_key(spark, path):
    files = [(f"f{k}", "2024-01-02", 1, 0, 2, 100, at(k // 2)) for k in range(8)]  # a task rolled over to a second file
    rows = [("k", f"v{k}", "2024-01-02", 1, 0, at(k // 2)) for k in range(8)] * 2
    got = compaction.compact(spark, spark.createDataFrame(files, LISTING), spark.createDataFrame(rows, CLICKS), ["dt", "hour"], FILE_OF_ROW, root=path, target=450).collect()
    assert [(r["files_before"], r["files_after"], r["n_records"]) for r in got] == [(8, 2, 16)]


def test_compaction_splits_by_target(spark, path):
    listing, rows = listing_and_rows(spark)
    got = compaction.compact(spark, listing, rows, ["dt", "hour"], FILE_OF_ROW, root=path, target=330).collect()
    assert got[0]["files_after"] == 3 and got[0]["n_records"] == 14


def test_compaction_nothing_to_do(spark, path):
    listing, rows = listing_and_rows(spark)
    assert compaction.compact(spark, listing.limit(0), rows, ["dt", "hour"], FILE_OF_ROW, root=path + "/a").count() == 0
    assert compaction.compact(spark, listing, rows.limit(0), ["dt", "hour"], FILE_OF_ROW, root=path + "/b").count() == 0


def test_plan_in_blocks(spark):
    listing, rows = listing_and_rows(spark)
    m = compaction.frozen_manifest(listing, rows, FILE_OF_ROW)
    plan = compaction.plan_bins(m, compaction.candidates(m, ["dt", "hour"]), ["dt", "hour"], list(FILE_OF_ROW.values()), block=3).collect()
    assert len(plan) == 7 and len({r["block"] for r in plan}) > 1


# --- 6 ---

MESSAGES = "value string, kafka_timestamp timestamp"


def test_arrivals_and_cut_off(spark):
    ids = [f"{i:032x}" for i in range(6)]
    hour = 3600
    e = events(
        spark,
        {"event_id": ids[0], "updated_at": at(hour + 86400)},  # right on the cut-off
        {"event_id": ids[1], "updated_at": at(hour + 86401)},  # one second beyond
        {"event_id": ids[2], "updated_at": at(9 * 86400)},  # its message came early
        {"event_id": ids[3], "updated_at": at(60)},  # its message came late: that counts
        {"event_id": ids[4], "event_timestamp": None, "updated_at": at(9 * 86400)},
        {"updated_at": at(9 * 86400)},
        {"event_id": ids[5], "updated_at": at(70), "event_timestamp": at(-7200)},
        {"event_id": ids[5].upper(), "updated_at": at(80), "event_timestamp": at(-90 * 86400)},  # not the standing row
    )
    m = spark.createDataFrame([(json.dumps({"event_id": ids[2]}), at(30)), (json.dumps({"event_id": ids[2]}), at(10**6)), (json.dumps({"event_id": ids[3]}), at(2 * 86400)), ("{bad", at(0)), (None, None)], MESSAGES)
    p = late_events.punctuate(late_events.arrivals(e, m, "event_timestamp", "event_type", "source")).cache()
    late = late_events.diverted(p)
    assert {r["event_id"] for r in late.collect()} == {ids[1], ids[3], None}
    c = {r["period_start"]: r for r in late_events.corrected_counts(p, ("click",)).collect()}
    h = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    assert c[h]["n_click"] == 2 and c[h]["n_diverted"] == 3 and c[h]["corrections"] == 1 and c[h]["first_click"] == 1
    assert c[h - 7200]["n_click"] == 1 and c[h - 7200]["corrections"] == 1


ARRIVED = "event_type string, source string, event_timestamp timestamp, arrival timestamp"


def test_period_closes_when_every_source_passed(spark):
    e = spark.createDataFrame([("click", s, at(0), at(a)) for s, a in (("a", 10), ("a", 90000 + 100), ("b", 20), ("b", 90000 + 5000), ("idle", 30))], ARRIVED)
    close = lambda df, **kw: late_events.closings(late_events.low_watermarks(late_events.periods(df), **kw)).first()
    h = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    r = close(e, idle=6 * 3600)
    assert r["closed_us"] / 1e6 - h == 3600 + 86400 + 6 * 3600 and r["active_sources"] == 2  # the idle one is waited for no longer
    assert close(e.where("source <> 'idle'"))["closed_us"] / 1e6 - h == 90000 + 5000


def test_watermarks_decide(spark):
    e = spark.createDataFrame(
        [("click", s, None if t is None else at(t), None if a is None else at(a)) for s, t, a in (("a", 0, 10), ("a", 1, 90000), ("a", 2, 90001), ("a", 3, 90900), ("b", 4, 94000), (None, 5, 20), ("c", -50_000, 30_000), ("c", 100_000, None), ("c", None, 5))], ARRIVED
    ).withColumns({"src": F.lit("clash"), "slot": F.lit(1), "first": F.lit(2)})
    p = late_events.punctuate(e)
    assert {r["arrival"] for r in p.where("diverted").collect()} == {at(90001), at(90900), at(94000)}
    assert set(e.columns) <= set(p.columns) and {r["src"] for r in p.collect()} == {"clash"}
    h = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    counts = lambda **kw: {r["period_start"] - h: r for r in late_events.corrected_counts(late_events.punctuate(e, **kw), ("click",)).collect()}
    # c and the nameless source never pass: the time-out closes the hour
    assert (counts()[0]["n_diverted"], counts()[0]["n_after_close"], counts()[0]["closed_at"] - h) == (3, 0, 90000 + 21600)
    assert (counts(idle=600)[0]["n_diverted"], counts(idle=600)[0]["n_after_close"], counts(idle=600)[0]["closed_at"] - h) == (3, 2, 90600)
    assert counts(lateness=7200 + 7)[0]["n_diverted"] == 4  # not a whole number of periods
    later = e.unionByName(spark.createDataFrame([("click", "d", at(0), at(90300))], ARRIVED).withColumns({"src": F.lit("x"), "slot": F.lit(1), "first": F.lit(2)}))
    assert late_events.corrected_counts(late_events.punctuate(later, idle=900), ("click",)).where(f"period_start = {h}").first()["active_sources"] == 2


def test_watermark_is_in_the_plan(spark):
    from tidewell.plans import problems

    from conftest import SF

    plan = problems.p6_found(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "punctuated_us" in plan and "Join" in plan and "watermarks" in plan


def test_punctuations_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(late_events, "BROADCAST_MARKS", 0)
    e = spark.createDataFrame([("click", "a", at(k), at(k * 4000)) for k in range(40)], ARRIVED)
    assert late_events.punctuate(e).where("diverted").count() == sum(k * 4000 > 90000 for k in range(40))


def test_late_empty(spark):
    p = late_events.punctuate(late_events.arrivals(events(spark), spark.createDataFrame([], MESSAGES), "event_timestamp", "event_type", "source"))
    assert late_events.diverted(p).count() == 0 and late_events.corrected_counts(p, ("click",)).count() == 0


# --- 7 ---


def test_index_over_batches(spark, path):
    rng = random.Random(5)
    seen: set = set()
    for call in range(dedup_index.MAX_RUNS + 3):
        rows = [(rng.choice([None, *(f"id{k}" for k in range(60))]) if rng.random() < 0.9 else "hot", f"b{rng.randrange(3)}", k) for k in range(120)]
        df = spark.createDataFrame(rows, "i string, b string, o bigint").withColumn("id", F.lit("clash"))
        index = dedup_index.IdentifierIndex(spark, path, bits=2)
        got = {(r["id"], r["batch"]): (r["n"], r["known"]) for r in index.ingest(df, bare_id("i"), F.col("b"), F.col("o")).collect()}
        want, now = {}, set(seen)
        for b in ("b0", "b1", "b2"):
            counts = Counter(i for i, x, _ in rows if x == b and i is not None)
            for i, n in counts.items():
                want[(i, b)] = (n, i in now)
            now |= set(counts)
        assert got == want
        seen = now
    assert len(dedup_index.IdentifierIndex(spark, path).live) < dedup_index.MAX_RUNS


def test_index_outlives_a_crash(spark, path, monkeypatch):
    df = spark.createDataFrame([("x", "1", 5), ("y", "1", 3)], "i string, b string, o bigint")
    by = bare_id("i"), F.col("b"), F.col("o")

    def lost(*_):
        raise OSError("executor lost")

    index = dedup_index.IdentifierIndex(spark, path)
    with monkeypatch.context() as m:
        m.setattr(dedup_index, "create_json", lost)
        with pytest.raises(OSError):
            index.ingest(df, *by)
    again = dedup_index.IdentifierIndex(spark, path)
    other = dedup_index.IdentifierIndex(spark, path)
    assert {r["known"] for r in again.ingest(df, *by).collect()} == {False}
    with pytest.raises(CommitConflict):  # two writers at a time
        other.ingest(spark.createDataFrame([("z", "1", 1)], "i string, b string, o bigint"), *by)
    last = dedup_index.IdentifierIndex(spark, path)
    assert {r["id"]: r["known"] for r in last.ingest(spark.createDataFrame([("x", "2", 5), ("z", "2", 3)], "i string, b string, o bigint"), *by).collect()} == {"x": True, "z": False}


def test_index_prefixes_grow(spark, path):
    by = bare_id("i"), F.col("b"), F.col("o")
    make = lambda ids: spark.createDataFrame([(f"id{k}", "b", k) for k in ids], "i string, b string, o bigint")
    calls = [range(3), range(2, 400), range(300, 2000), range(1990, 2100), range(0, 2200)]
    seen: set = set()
    for ids in calls:
        index = dedup_index.IdentifierIndex(spark, path, bits=1, max_runs=4, ids_per_prefix=50)
        got = {int(r["id"][2:]): r["known"] for r in index.ingest(make(ids), *by).collect()}
        assert got == {k: k in seen for k in ids}
        seen |= set(ids)
    assert index.bits >= 5 and max(int(p.rpartition("/")[2][:-4]) for p, _, _ in walk(spark, f"{path}/runs") if p.endswith(".npy")) >= 31
    sizes = [len(dedup_index._load(p)) for p, _, _ in walk(spark, f"{path}/runs/{index.live[-1]['name']}") if p.endswith(".npy")]
    assert sizes and max(sizes) < 150


def test_index_in_slices(spark, path):
    rows = [(f"id{k % 37}", f"b{k % 7}", k) for k in range(300)] + [(None, "b1", 0), ("id1", None, 5)]
    df = spark.createDataFrame(rows, "i string, b string, o bigint")
    by = bare_id("i"), F.col("b"), F.col("o")
    index = dedup_index.IdentifierIndex(spark, path + "/s", max_runs=3)
    whole = dedup_index.IdentifierIndex(spark, path + "/w").ingest(df, *by)
    assert Counter(index.ingest_slices(df, *by, slices=3).collect()) == Counter(whole.collect()) and index.version == 3 and len(index.live) == 1
    assert dedup_index.IdentifierIndex(spark, path + "/e").ingest_slices(df.limit(0), *by, slices=3).count() == 0


def test_index_copies_and_kept(spark, path):
    df = spark.createDataFrame([("x", "1", 5), ("X", "1", 3), ("y", "1", 1), ("y", "2", 2), ("z", "2", 9), (None, "2", 1), ("q\u0000", None, 1)], "i string, b string, o bigint")
    r = dedup_index.IdentifierIndex(spark, path).ingest(df, bare_id("i"), F.col("b"), F.col("o"))
    assert {x["id"] for x in dedup_index.copies(r).collect()} == {"x", "y"}
    assert {(x["id"], x["first_at"]) for x in dedup_index.kept(r).collect()} == {("x", 3), ("y", 1), ("z", 9), ("q", 1)}
    empty = dedup_index.IdentifierIndex(spark, path + "/e").ingest(df.limit(0), bare_id("i"), F.col("b"), F.col("o"))
    assert empty.count() == 0


def test_kept_rows_are_whole(spark, path):
    rows = [("x", "1", 5, 1, "c"), ("X", "1", 3, 9, "b"), ("x", "1", 3, 2, "z"), ("x", "1", 3, 2, "a"), ("y", "2", None, 1, "n"), ("y", "2", 8, 1, "m"), (None, "2", 1, 1, "p"), (None, "2", 1, 1, "p"), ("  ", None, None, None, None)]
    df = spark.createDataFrame(rows, "i string, b string, o bigint, k int, content string")
    by = bare_id("i"), F.col("b"), F.col("o")

    def whole(df):
        r = dedup_index.IdentifierIndex(spark, path).ingest(df, *by)
        return Counter(tuple(x) for x in dedup_index.kept_rows(df, r, *by, ties=("k",)).select("__id", *df.columns).collect())

    alone = [(None, *r) for r in rows[6:]]
    assert whole(df) == Counter([("x", *rows[3]), ("y", *rows[5]), *alone])
    assert whole(df) == Counter(alone)  # identifiers known from before


def test_registered_rows_after_deduplication(spark):
    from tidewell.plans import problems
    from tidewell.sources.tables import load

    from conftest import SF

    for table, query, ident in (("ad_clicks", problems.p7_clicks_rows, message_id("value")), ("processed_events", problems.p7_events_rows, bare_id("event_id"))):
        df, got = load(spark, SF, table), query(spark, SF)
        n = df.select(F.count_distinct(ident) + F.count_if(ident.isNull())).first()[0]
        assert got.count() == n and set(df.columns) <= set(got.columns)


# --- shared folder ---


def test_shared_folder(spark):
    from tidewell import session

    root = spark.conf.get("spark.checkpoint.dir", None)
    assert not root or session.shared_dir(spark) == root.rstrip("/")
    made = session.materialise(spark.range(5), "five")
    assert made.count() == 5 and session._own(spark).rpartition("//")[2] in made.inputFiles()[0]
    session.clear_scratch(spark)
    assert walk(spark, session._own(spark)) == []
