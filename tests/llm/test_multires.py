"""Distinct counts by multiresolution bitmaps, against exact counts."""

import datetime as dt
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import multires

D0 = dt.date(2024, 1, 2)


def day(k):
    return None if k is None else D0 + dt.timedelta(days=k)


def visits(spark, *rows):
    return spark.createDataFrame([(u, day(d), c, 1, 2) for u, d, c in rows], "uid string, event_date date, campaign_id int, level int, first_day int")


@pytest.mark.parametrize("n", [1, 50, 3000, 60_000, 400_000])
def test_estimate_within_bound(spark, n):
    df = spark.range(n).select(F.concat(F.lit("u"), "id").alias("uid"), F.lit(1).alias("g"))
    r = multires.estimate(multires.partial_bitmaps(df, "uid", ["g"]), ["g"]).first()
    assert abs(r["estimate"] - n) <= max(1, r["rel_error"] * n)


def test_error_over_many_sets(spark):
    n = 20_000
    df = spark.range(n * 40).select(F.col("id").alias("uid"), F.pmod("id", F.lit(40)).alias("g"))
    rel = np.array([r["estimate"] / n - 1 for r in multires.estimate(multires.partial_bitmaps(df, "uid", ["g"]), ["g"]).collect()])
    assert len(rel) == 40 and np.sqrt((rel**2).mean()) < 1 / np.sqrt(multires.BITS) and (abs(rel) <= 2 / np.sqrt(multires.BITS)).mean() >= 0.9


def test_partial_results_merge(spark):
    df = spark.range(30_000).select("id", F.lit(1).alias("g"))
    parts = multires.partial_bitmaps(df.where("id < 20000"), "id", ["g"]).unionByName(multires.partial_bitmaps(df.where("id >= 10000"), "id", ["g"]))
    whole = multires.partial_bitmaps(df, "id", ["g"])
    assert sorted(multires.merge_bitmaps(parts, ["g"]).collect()) == sorted(whole.collect())


def test_distinct_counts_small(spark):
    df = visits(spark, ("a", 0, 1), ("a", 0, 1), ("b", 1, 1), (None, 0, 1), ("c", None, None))
    got = {(r["grain"], str(r["first_day"]), str(r["last_day"]), r["campaign_id"]): r["estimate"] for r in multires.distinct_counts(df, "uid", "event_date", "campaign_id").collect()}
    assert got[("all", "None", "None", None)] == 3
    assert got[("campaign_id", "None", "None", 1)] == 2 and got[("campaign_id", "None", "None", None)] == 1
    assert got[("event_date", "2024-01-02", "2024-01-02", None)] == 1 and got[("event_date", "None", "None", None)] == 1
    assert got[("range", "2024-01-02", "2024-01-03", None)] == 2 and got[("range+campaign_id", "2024-01-02", "2024-01-03", 1)] == 2
    assert multires.distinct_counts(df.limit(0), "uid", "event_date", "campaign_id").count() == 0
    assert multires.distinct_counts(df.where("event_date IS NULL"), "uid", "event_date", "campaign_id").count() == 4


@pytest.mark.parametrize("days", [1, 2, 5, 8, 40])
def test_every_range_of_days(spark, days):
    rng = random.Random(days)
    rows = [(f"u{rng.randrange(30)}", rng.choice([0, days - 1, rng.randrange(days)]), rng.choice([1, 2, None])) for _ in range(80)] + [("first", 0, 1), ("last", days - 1, 1), ("x", None, 1)]
    got = {(r["grain"], r["first_day"], r["last_day"], r["campaign_id"]): r["estimate"] for r in multires.distinct_counts(visits(spark, *rows), "uid", "event_date", "campaign_id").where("grain like 'range%'").collect()}
    want = defaultdict(set)
    for a, b in itertools.combinations_with_replacement(range(days), 2):
        for u, d, c in rows:
            if d is not None and a <= d <= b:
                want["range+campaign_id", day(a), day(b), c].add(u)
                want["range", day(a), day(b), None].add(u)
    assert got == {k: len(v) for k, v in want.items()}  # sets this small are counted exactly


def test_asked_ranges(spark):
    df = visits(spark, ("u0", 0, 1), ("u20", 20, 1), ("u39", 39, 1), ("u0", 39, 2))
    blocks = multires.dyadic_blocks(multires.partial_bitmaps(df, "uid", ["event_date", "campaign_id"]), "event_date", "campaign_id")
    asked = spark.createDataFrame([(dt.date(2023, 1, 1), dt.date(2025, 1, 1)), (day(1), day(39)), (day(1), day(39)), (day(400), day(500)), (day(3), day(2)), (None, day(9)), (day(20), day(20))], "first_day date, last_day date")
    got = {(r["grain"], r["first_day"], r["campaign_id"]): r["estimate"] for r in multires.range_counts(blocks, asked, "campaign_id").collect()}
    assert got == {
        ("range", dt.date(2023, 1, 1), None): 3, ("range+campaign_id", dt.date(2023, 1, 1), 1): 3, ("range+campaign_id", dt.date(2023, 1, 1), 2): 1, ("range", day(1), None): 3,
        ("range+campaign_id", day(1), 1): 2, ("range+campaign_id", day(1), 2): 1, ("range", day(20), None): 1, ("range+campaign_id", day(20), 1): 1,
    }
    empty = multires.dyadic_blocks(multires.partial_bitmaps(df.limit(0), "uid", ["event_date", "campaign_id"]), "event_date", "campaign_id")
    assert multires.range_counts(empty, asked, "campaign_id").count() == 0


def test_ranges_shuffle_in_proportion_to_days(spark):
    def shuffled(days):
        df = spark.range(days * 2000).select(F.col("id").cast("string").alias("uid"), F.date_add(F.lit(D0), F.pmod("id", F.lit(days)).cast("int")).alias("event_date"), (F.pmod(F.hash("id"), F.lit(3))).alias("campaign_id"))
        bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
        bus.waitUntilEmpty(30_000)
        before = store.executorList(False).apply(0).totalShuffleWrite()
        multires.distinct_counts(df, "uid", "event_date", "campaign_id").write.format("noop").mode("overwrite").save()
        bus.waitUntilEmpty(30_000)
        return store.executorList(False).apply(0).totalShuffleWrite() - before

    assert shuffled(32) < 6 * shuffled(8)  # words copied into every range would make it 16 times


@pytest.mark.parametrize("bits", [64, 1024])
def test_ranges_of_full_slices(spark, bits):
    offset = F.element_at(F.array(*map(F.lit, [0, 1, 2, 6, 7, 13])), F.pmod("id", F.lit(6)).cast("int") + 1)
    df = spark.range(60_000).select("id", F.date_add(F.lit(D0), offset).alias("event_date"), F.when(F.col("id") % 5 < 4, (F.col("id") % 4).cast("string")).alias("site_cat"))
    got = multires.distinct_counts(df, "id", "event_date", "site_cat", bits).where("grain like 'range%'")
    asked = spark.createDataFrame([(day(a), day(b)) for a, b in itertools.combinations_with_replacement(range(14), 2)], "first_day date, last_day date")
    blocks = multires.dyadic_blocks(multires.partial_bitmaps(df, "id", ["event_date", "site_cat"], bits), "event_date", "site_cat")
    want = multires.range_counts(blocks, asked, "site_cat", bits)
    assert got.schema.names == want.schema.names and Counter(got.collect()) == Counter(want.collect())


def test_errors_beside_exact_counts(spark):
    df = visits(spark, *((f"u{k % 900}", k % 3, k % 5) for k in range(3000)), (None, 0, 1), ("x", None, None))
    got = {r["grain"]: tuple(r)[1:] for r in multires.errors(df, "uid", "event_date", "campaign_id").collect()}
    assert got["all"] == (1, 901, True) and got["event_date"][0] == 4 and got["event_date+campaign_id"][0] == 16 and all(r[2] for r in got.values())
