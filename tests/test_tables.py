"""The managed table, its upkeep and streaming ingest."""

import datetime as dt
import time
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewell.streaming import ingest, windows
from tidewell.table import maintenance
from tidewell.table.files import CommitConflict, create_json, read_json, walk
from tidewell.table.managed import ManagedTable

DDL = "k string, day date, v double, note string, updated_at timestamp"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 2)
D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def df(spark, *rows, at=T1):
    return spark.createDataFrame([(*r, at) for r in rows], DDL)


def table(spark, path, **props):
    return ManagedTable.create_if_not_exists(spark, f"{path}/t", DDL, ["day"], props)


def content(t, **kw):
    return sorted(map(tuple, t.scan(**kw).collect()), key=str)


def test_create_json_is_exclusive(spark, path):
    create_json(spark, f"{path}/a.json", {"x": "ü"})
    with pytest.raises(CommitConflict):
        create_json(spark, f"{path}/a.json", {"x": 2})
    assert read_json(spark, f"{path}/a.json") == {"x": "ü"} and len([p for p, _, _ in walk(spark, path) if p.endswith(".json")]) == 1


def test_append_snapshots_and_time_travel(spark, path):
    t = table(spark, path)
    assert t.scan().count() == 0 and t.snapshots().count() == 0
    t.append(df(spark, ("a", D1, 1.0, None), ("b", None, 2.0, "x/y:z %")))
    t.append(df(spark, ("c", D2, 3.0, None)))
    assert t.append(df(spark)) is None
    assert [r[0] for r in content(t)] == ["a", "b", "c"] and [r[0] for r in content(t, version=1)] == ["a", "b"]
    assert [r[0] for r in content(t, where=lambda p: p["day"] == "2024-01-02")] == ["c"]
    assert [(r["operation"], r["summary"]["added-records"]) for r in t.snapshots().orderBy("version").collect()] == [("append", "2"), ("append", "1")]
    assert t.files().agg(F.sum("record_count")).first()[0] == 3 and t.manifests().count() == 2


def test_files_pruned_by_their_greatest_value(spark, path):
    t = table(spark, path, stats=["updated_at"])
    t.append(df(spark, ("a", D1, 1.0, None)))
    t.append(df(spark, ("b", D1, 1.0, None), at=T2))
    t.append(df(spark, ("c", D1, 1.0, None), at=None))
    assert [r[0] for r in content(t, at_least={"updated_at": "2024-01-15 00:00:00"})] == ["b"]
    assert [r[0] for r in content(t, at_least={"updated_at": "2024-01-01 00:00:00"})] == ["a", "b"] and len(content(t)) == 3


def test_partition_overwrite(spark, path):
    t = table(spark, path)
    t.append(df(spark, ("a", D1, 1.0, None), ("b", D2, 2.0, None)))
    t.overwrite_partitions(df(spark, ("c", D1, 9.0, None)))
    assert [(r[0], r[2]) for r in content(t)] == [("b", 2.0), ("c", 9.0)]


def test_delete_keeps_nulls(spark, path):
    t = table(spark, path)
    t.append(df(spark, ("a", D1, 1.0, None), ("b", D1, None, None), ("c", D1, 5.0, None), ("d", D2, 0.0, None)))
    t.delete_where(F.col("v") >= 1)
    assert [r[0] for r in content(t)] == ["b", "d"]
    assert t.delete_where(F.col("v") >= 100) is None and len(t.versions()) == 2


def test_merge_cases(spark, path):
    t = table(spark, path)
    t.merge(df(spark, ("same", D1, 1.0, None), ("filled", D1, None, None), ("moved", D1, 3.0, "m"), ("alone", D2, 4.0, None)), "k")
    t.merge(df(spark, ("same", D1, 1.0, None), ("filled", D1, 330.0, None), ("moved", D2, 3.0, "m"), ("new", D2, 5.0, None), at=T2), "k")
    got = {r[0]: (r[1], r[2], r[4]) for r in content(t)}
    assert got == {"same": (D1, 1.0, T1), "filled": (D1, 330.0, T2), "moved": (D2, 3.0, T2), "alone": (D2, 4.0, T1), "new": (D2, 5.0, T2)}
    n = len(t.versions())
    assert t.merge(df(spark, ("same", D1, 1.0, None), ("new", D2, 5.0, None), at=dt.datetime(2025, 1, 1)), "k") is None and len(t.versions()) == n


def test_merge_rewrites_only_touched_files(spark, path):
    t = table(spark, path)
    t.append(df(spark, ("a", D1, 1.0, None)))
    t.append(df(spark, ("b", D2, 2.0, None)))
    before = {r["file_path"] for r in t.files().collect()}
    t.merge(df(spark, ("b", D2, 7.0, None), at=T2), "k")
    after = {r["file_path"] for r in t.files().collect()}
    assert len(before & after) == 1 and [(r[0], r[2]) for r in content(t)] == [("a", 1.0), ("b", 7.0)]


def test_merge_refuses_repeated_keys(spark, path):
    t = table(spark, path)
    t.merge(df(spark, ("a", D1, 1.0, None), (None, D1, 1.0, None), (None, D1, 1.0, None)), "k")
    with pytest.raises(ValueError, match="'b'"):
        t.merge(df(spark, ("a", D1, 2.0, None), ("b", D1, 3.0, None), ("b", D2, 4.0, None)), "k")
    assert Counter((r[0], r[2]) for r in content(t)) == Counter([(None, 1.0), (None, 1.0), ("a", 1.0)])
    assert len(t.versions()) == 1 and not [p for p, _, _ in walk(spark, f"{path}/t/data") if "_merge-" in p]


def test_merge_meets_another_writer(spark, path, monkeypatch):
    t = table(spark, path)
    for start in (False, True):  # onto an empty table, and onto one with rows
        plain = ManagedTable._stage

        def stage(self, rows, *a):
            out = plain(self, rows, *a)
            monkeypatch.setattr(ManagedTable, "_stage", plain)
            self.append(df(spark, ("x", D2, float(start), None)))
            monkeypatch.setattr(ManagedTable, "_stage", stage)
            return out

        monkeypatch.setattr(ManagedTable, "_stage", stage)
        with pytest.raises(CommitConflict):
            t.merge(df(spark, ("x", D1, 7.0, None)), "k")
        monkeypatch.setattr(ManagedTable, "_stage", plain)
    assert {r[2] for r in content(t)} == {0.0, 1.0}
    with pytest.raises(ValueError):
        table(spark, path + "/e").merge(df(spark, ("x", D1, 7.0, None), ("x", D1, 8.0, None)), "k")
    assert not [p for p, _, _ in walk(spark, f"{path}/e/t/data") if p.endswith(".parquet")]


def test_one_partition_of_several_targets_takes_several_files(spark, path):
    t = table(spark, path, **{"target-bytes": 40_000})
    big = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.lit(D1).alias("day"), F.rand(1).alias("v"), F.md5(F.rand(2).cast("string")).alias("note"), F.lit(T1).alias("updated_at"))
    t.append(big.repartition(16))
    files = t.files().collect()
    assert len(files) > 5 and sum(f["record_count"] for f in files) == 60_000 and {f["partition"]["day"] for f in files} == {"2024-01-01"}


def test_drop_partitions(spark, path):
    t = table(spark, path)
    t.append(df(spark, ("a", D1, 1.0, None), ("b", D2, 2.0, None), ("n", None, 2.0, None)))
    t.drop_partitions(lambda p: p["day"] == "2024-01-01")
    assert [r[0] for r in content(t)] == ["b", "n"] and t.drop_partitions(lambda p: False) is None


def test_epoch_mark_outlives_other_snapshots(spark, path):
    t = table(spark, path)
    t.append(df(spark, ("a", D1, 1.0, None)), ingest.epoch_mark("q", 7))
    for k in range(25):
        t.append(df(spark, (f"k{k}", D1, 0.0, None)))
    maintenance.compact(t)
    maintenance.expire(t, 2**60, 1)
    assert len(t.versions()) == 1 and ingest.has_epoch(t, "q", 7) and not ingest.has_epoch(t, "q", 8) and not ingest.has_epoch(t, "r", 0)


def test_conflicts(spark, path):
    t = table(spark, path)
    t.append(df(spark, ("a", D1, 1.0, None)))
    base = t.snapshot()
    files = {e["path"] for e in t._entries(base)}
    staged = t._stage(df(spark, ("a", D1, 2.0, None)))
    t.overwrite_partitions(df(spark, ("z", D1, 0.0, None)))
    with pytest.raises(CommitConflict):
        t._commit(base, "overwrite", staged, files)
    assert [r[0] for r in content(t)] == ["z"]
    t._commit(base, "append", t._stage(df(spark, ("late", D2, 1.0, None))), set())  # appends go on top of the newest
    assert [r[0] for r in content(t)] == ["late", "z"]


def test_maintenance(spark, path):
    t = table(spark, path)
    for k in range(7):
        t.append(df(spark, (f"k{k}", D1, float(k), None)))
    t.append(df(spark, ("other", D2, 0.0, None)))
    want = Counter(content(t))
    assert maintenance.maintain(t, ["compact"], dry_run=True)["ran"] == [] and len(t.versions()) == 8
    r = maintenance.maintain(t, ["orphan", "compact", "vacuum"], orphan_hours=1)
    assert r["ran"] == ["compact", "orphan"] and r["compact"]["rewritten_files"] == 7 and r["compact"]["added_files"] == 1 and r["orphan"]["older_than_hours"] == 24
    assert Counter(content(t)) == want and r["after"]["files"] == 2
    r = maintenance.expire(t, 2**60, 5)
    assert r["expired_snapshots"] == 4 and len(t.versions()) == 5 and Counter(content(t)) == want
    assert maintenance.expire(t, 0, 1)["expired_snapshots"] == 0
    maintenance.expire(t, 2**60, 1)
    assert t.files().count() == 2 and Counter(content(t)) == want
    t._stage(df(spark, ("lost", D1, 0.0, None)))
    assert maintenance.remove_orphans(t, 1)["deleted_orphans"] == 0
    assert maintenance.remove_orphans(t, 1, now_ms=int(time.time() * 1000) + 10**9)["deleted_orphans"] >= 1 and Counter(content(t)) == want


def test_compaction_keeps_odd_partition_values(spark, path):
    t = ManagedTable.create_if_not_exists(spark, f"{path}/odd", "k string, p string", ["p"], {"target-bytes": 2500})
    for k in range(9):
        t.append(spark.createDataFrame([(f"{k}", "a b/c:%20+ü"), (f"{k}", None)], "k string, p string"))
    want = Counter(map(tuple, t.scan().collect()))
    r = maintenance.compact(t)
    assert r["rewritten_files"] == 18 and 2 < r["added_files"] < 18 and Counter(map(tuple, t.scan().collect())) == want
    assert {r["p"]: r["n"] for r in t.files().groupBy(F.col("partition")["p"].alias("p")).agg(F.sum("record_count").alias("n")).collect()} == {"a b/c:%20+ü": 9, None: 9}


# --- streaming ---


def landing(spark, path, *topics):
    rows = [(f"k{k}", "{}", t, 0, k, T1) for k, t in enumerate(topics)]
    spark.createDataFrame(rows, ingest.LANDING).coalesce(1).write.mode("append").parquet(path)


def test_ingest_restarts_without_loss_or_repeats(spark, path):
    bronze = "key string, value string, topic string, kafka_partition int, kafka_offset bigint, kafka_timestamp timestamp, ingested_at timestamp, dt string, hour int"
    tables = {n: ManagedTable.create_if_not_exists(spark, f"{path}/{n}", bronze, ["dt"]) for n in ("ad_clicks", "ad_requests")}
    run = lambda: ingest.start(ingest.file_stream(spark, f"{path}/in"), tables, f"{path}/check", every=None).awaitTermination()
    landing(spark, f"{path}/in", "ad-clicks", "ad-clicks", "ad-requests", "ad-unknown", None)
    run()
    run()
    assert (tables["ad_clicks"].scan().count(), tables["ad_requests"].scan().count()) == (2, 1)
    landing(spark, f"{path}/in", "ad-clicks")
    run()
    assert tables["ad_clicks"].scan().count() == 3
    write = ingest.router(tables, "bronze")
    write(tables["ad_clicks"].scan(), 0)  # an epoch that ran before
    assert tables["ad_clicks"].scan().count() == 3


class Failing:
    def __init__(self, error):
        self.error = error

    def awaitTermination(self):
        if self.error:
            raise StreamingQueryException("boom")


def test_supervisor_backs_off_and_gives_up():
    waits, alerts = [], []

    def alert(text):
        alerts.append(text)
        raise RuntimeError("no network")

    with pytest.raises(StreamingQueryException):
        ingest.supervise(lambda: Failing(True), alert, waits.append, lambda: 0.0)
    assert waits == [10, 20, 40, 80, 160] and len(alerts) == 1


def test_supervisor_resets_after_a_long_run():
    waits, clock = [], iter([0, 700] * 8 + [0, 0])
    runs = iter([True] * 8 + [False])
    assert ingest.supervise(lambda: Failing(next(runs)), sleep=waits.append, clock=lambda: next(clock)) == 8
    assert waits == [10] * 8


def drain(stream, path, mode="append"):
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()


def test_stream_sessions_and_unique(spark, path):
    rows = [("u", T1 + dt.timedelta(seconds=s), f"m{s % 3}") for s in (0, 1800, 3601, 10)] + [("v", T1 + dt.timedelta(days=9), "x"), ("w", T1 + dt.timedelta(days=12), "y")]
    d = spark.createDataFrame(rows, "uid string, event_timestamp timestamp, mid string")
    d.coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{path}/in")
    drain(windows.stream_sessions(stream), f"{path}/s")
    got = spark.read.parquet(f"{path}/s/out").where("uid = 'u'").select((F.col("session_end") - F.col("session_start")).alias("d"), "n_events").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1800, 3)]
    drain(windows.stream_unique(stream, "mid", "event_timestamp"), f"{path}/u")
    assert spark.read.parquet(f"{path}/u/out").count() == 4
    typed = stream.withColumn("event_type", F.lit("click"))
    drain(windows.stream_hourly({"a": typed, "b": typed}), f"{path}/h")
    first = spark.read.parquet(f"{path}/h/out").orderBy("period_start").first()
    assert first["n"] == 6


def test_late_stream_closes_when_every_source_passed(spark, path):
    from tidewell.streaming.late import LateEvents

    schema = "event_id string, source string, event_type string, event_timestamp timestamp, arrival timestamp"
    base = dt.datetime(2024, 1, 1)
    row = lambda i, s, t, a: (i, s, "click", base + dt.timedelta(seconds=t), base + dt.timedelta(seconds=a))
    late = LateEvents(spark, path, lateness=7200, idle=36_000)
    epoch0 = int((base - dt.datetime(1970, 1, 1)).total_seconds())
    batches = [
        [row("a1", "a", 10, 20), row("b1", "b", 30, 40), row("none", "a", 10, 20)[:3] + (None, base)],
        [row("a2", "a", 3600, 3700 + 7200), row("a3", "a", 20, 10_800), row("a4", "a", 20, 10_801)],  # a3 on the cut-off, a4 beyond
        [row("b2", "b", 50, 9000)],  # late, but b hasn't passed: corrected
        [row("b3", "b", 7300, 10_900)],  # now every source has passed the first hour
        [row("b4", "b", 60, 10_700)],  # closed already
        [row("a5", "a", 100_000, 100_000)],  # b is idle by now
    ]
    closed = []
    for k, b in enumerate(batches):
        df_ = spark.createDataFrame(b, schema)
        late(df_, k)
        late(df_, k)  # run again after a failure
        late = LateEvents(spark, path, lateness=7200, idle=36_000)
        closed.append({r["period_start"] - epoch0: r["n"] for r in late.closed.scan().collect()})
    assert closed == [{}, {}, {}, {0: 4}, {0: 4}, {0: 4, 3600: 1, 7200: 1}]
    assert {r["event_id"] for r in late.diverted.scan().collect()} == {"a4", "b4"}
    assert {r["period_start"] - epoch0: r["n"] for r in late.open_counts().collect()} == {97200: 1}


def test_late_stream_never_reopens(spark, path):
    from tidewell.streaming.late import LateEvents

    schema = "event_id string, source string, event_type string, event_timestamp timestamp, arrival timestamp"
    base = dt.datetime(2024, 1, 1)
    row = lambda i, s, t, a: (i, s, "click", base + dt.timedelta(hours=t), base + dt.timedelta(hours=a))
    late = LateEvents(spark, path, lateness=0, idle=6 * 3600)
    batches = [[row("b0", "b", 1.5, 1.6)], [row("a0", "a", 8.5, 8.6), row("a1", "a", 9.5, 9.6), row("a2", "a", 11.9, 12)], [row("b1", "b", 8.9, 8.95), row("b2", "b", 7.0, 8.95)], [row("a3", "a", 20.5, 20.6)]]
    for k, b in enumerate(batches):  # b is idle in the second and returns in the third
        late(spark.createDataFrame(b, schema), k)
        late(spark.createDataFrame(b, schema), k)
    start = int((base - dt.datetime(1970, 1, 1)).total_seconds())
    assert sorted(((r["period_start"] - start) // 3600, r["n"]) for r in late.closed.scan().collect()) == [(1, 1), (8, 1), (9, 1), (11, 1)]
    assert {r["event_id"] for r in late.diverted.scan().collect()} == {"b1", "b2"}
    assert {((r["period_start"] - start) // 3600, r["n"]) for r in late.open_counts().collect()} == {(20, 1)}
    late(spark.createDataFrame([row("a4", "a", 60.5, 60.6)], schema), 4)
    assert late.partials.scan().select("day").distinct().count() == 1  # days that are over are dropped


def test_changed_partitions_and_refresh(spark, path):
    from tidewell.plans import gold
    from tidewell.schemas import SILVER, SILVER_COLUMNS

    def silver(*rows):
        base = {"event_id": "e", "event_type": "click", "source": "dummy", "campaign_id": 1, "uid": "u", "cost": 1.0, "updated_at": T1}
        return spark.createDataFrame([tuple((dict.fromkeys(SILVER_COLUMNS) | base | r)[c] for c in SILVER_COLUMNS) for r in rows], SILVER)

    s = ManagedTable.create_if_not_exists(spark, f"{path}/s", SILVER, ["event_date"])
    m = ManagedTable.create_if_not_exists(spark, f"{path}/m", "campaign_id int, event_date date, requests bigint, impressions bigint, clicks bigint, conversions bigint, fill_rate double, ctr double, cvr double, cost double, cpa double, roas double, updated_at timestamp", ["event_date"])
    marts, days = {gold.campaign_daily: m}, lambda: {(str(r["event_date"]), r["clicks"]) for r in m.scan().collect()}
    s.merge(silver({"event_id": "x", "event_date": D1}, {"event_id": "y", "event_date": D2}), "event_id")
    assert gold.refresh_changed(s, 0, marts, F.lit(T1)) == ["2024-01-01", "2024-01-02"] and days() == {("2024-01-01", 1), ("2024-01-02", 1)}
    v = s.versions()[-1]
    assert gold.refresh_changed(s, v, marts, F.lit(T1)) == []
    s.merge(silver({"event_id": "x", "event_date": D2}), "event_id")  # its old day is empty now
    assert gold.refresh_changed(s, v, marts, F.lit(T2)) == ["2024-01-01", "2024-01-02"] and days() == {("2024-01-02", 2)}


def test_messages_never_fail():
    from tidewell.plans import notify

    def broken(_):
        raise OSError("no network")

    sent = []
    m = notify.failure_message("silver", ValueError("x" * 900), 2)
    assert notify.notify(m, sent.append) and sent == [m] and len(m["text"]) < 540
    assert not notify.notify(m, broken) and not notify.notify(m, None)


def bronze_rows(spark, *rows):
    full = [("k", v, t, 0, k, at, at, at.strftime("%Y-%m-%d"), at.hour) for k, (t, v, at) in enumerate(rows)]
    return spark.createDataFrame(full, "key string, value string, topic string, kafka_partition int, kafka_offset bigint, kafka_timestamp timestamp, ingested_at timestamp, dt string, hour int")


def test_window_scans_open_only_their_files(spark, path):
    from tidewell.plans import silver
    from tidewell.schemas import BRONZE, BRONZE_PARTITION

    t = ManagedTable.create_if_not_exists(spark, f"{path}/b", BRONZE, BRONZE_PARTITION, {"stats": ["ingested_at"]})
    start = dt.datetime(2024, 1, 1)
    t.append(bronze_rows(spark, *(("ad-clicks", "{}", start + dt.timedelta(hours=h)) for h in range(24 * 6))))
    as_of = dt.datetime(2024, 1, 6, 12)
    count = lambda **kw: (len((w := silver.scan_window([t], as_of, **kw)).inputFiles()), w.count())
    assert t.files().count() == 144
    assert count(window_days=2) == (72, 72) and count(window_days=2, hour=9) == (3, 3) and count(window_days=2, hour=-1) == (72, 72)
    assert count(lookback_hours=3) == (15, 15)  # from 9 o'clock to the day's end
    assert count(window_days=400, hour=25) == (0, 0)


def test_unknown_topics_are_kept(spark, path):
    from tidewell.schemas import BRONZE

    tables = {n: ManagedTable.create_if_not_exists(spark, f"{path}/{n}", BRONZE) for n in ("ad_clicks", "unrouted")}
    rest = tables.pop("unrouted")
    write = ingest.router(tables, "q", rest)
    batch = bronze_rows(spark, ("ad-clicks", "a", T1), ("ad-odd", "b", T1), (None, "c", T1))
    write(batch, 0)
    write(batch, 0)
    assert [r["value"] for r in tables["ad_clicks"].scan().collect()] == ["a"] and sorted(r["value"] for r in rest.scan().collect()) == ["b", "c"]


def test_generated_events_go_through_the_topics(spark, path):
    from tidewell.plans import generate, silver
    from tidewell.schemas import BRONZE, NATIVE_FIELDS
    from tidewell.sources import wire

    e = generate.random_funnel(spark, 3000, per_second=10).cache()
    assert e.columns == list(NATIVE_FIELDS) and sorted(map(str, e.collect())) == sorted(map(str, generate.random_funnel(spark, 3000, per_second=10).repartition(5).collect()))
    bad = e.where("bid_price < floor_price * 1.19 OR bid_price > floor_price * 1.81 OR floor_price NOT BETWEEN 0.25 AND 0.9 OR os IS NULL OR site_cat IS NULL")
    assert bad.count() == 0 and e.groupBy("campaign_id").agg(F.count_distinct("floor_price").alias("n")).where("n > 1").count() == 0
    assert e.agg(F.max("timestamp") - F.min("timestamp")).first()[0] == 299 and e.select("event_id").distinct().count() == e.count()
    steps = {r["event_type"]: r["n"] for r in e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert steps["request"] == 3000 and 2200 < steps["impression"] < 2600 and steps["click"] < 120
    assert generate.random_funnel(spark, 0).count() == 0
    wire.produce(wire.messages_of(e), landing=f"{path}/in")
    tables = {f"ad_{t}s": ManagedTable.create_if_not_exists(spark, f"{path}/ad_{t}s", BRONZE) for t in steps}
    ingest.start(ingest.file_stream(spark, f"{path}/in"), tables, f"{path}/cp", every=None).awaitTermination()
    raw = tables["ad_impressions"].scan()
    back = silver.parse_native(raw)
    assert back.count() == steps["impression"] and back.where("cost IS NULL OR event_timestamp IS NULL OR banner_id IS NULL").count() == 0


def test_trend_chart(spark):
    from tidewell.plans import gold

    k = spark.createDataFrame([(D1, 1.0), (D2, None), (dt.date(2024, 1, 3), 4.0)], "event_date date, ctr double")
    svg = gold.trend_chart(k, "ctr")
    assert svg.startswith("<svg") and svg.count("<polyline") == 2 and "2024-01-01 to 2024-01-03" in svg
    assert "no days" in gold.trend_chart(k.limit(0), "ctr")


def test_drained_sessions_take_late_events(spark, path):
    rows = [("u", T1 + dt.timedelta(minutes=m), T1 + dt.timedelta(days=d)) for m, d in ((0, 0), (50, 0), (25, 5), (300, 1), (5000, 4))] + [("v", T1, None), (None, T1, T1), ("w", None, T1)]
    e = spark.createDataFrame(rows, "uid string, event_timestamp timestamp, updated_at timestamp").withColumn("day", F.lit("x"))
    got = sorted((r["uid"], r["session_end"] - r["session_start"], r["n_events"]) for r in windows.drain_sessions(e).collect())
    assert got == [("u", 0, 1), ("u", 0, 1), ("u", 3000, 3), ("v", 0, 1)]
    dropped = windows.drain_sessions(e, lateness="1 hour", files=1)
    assert dropped.where("uid = 'u'").agg(F.sum("n_events")).first()[0] < 5
    assert windows.drain_sessions(e.limit(0)).count() == 0
