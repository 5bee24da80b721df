"""Event synthesis: replayed funnels, a random funnel and a healthy history of the campaign mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.ids import spelled
from tidewell.functions.kpi import ratio_or_zero
from tidewell.schemas import CTR, CVR, FILL_RATE, IMPRESSIONS_PER_CLICK, NATIVE_FIELDS, REQUESTS_PER_CLICK, REVENUE_PER_CONVERSION, SITE_CATEGORIES

SYNTHETIC_BASE, SYNTHETIC_CAMPAIGNS = 90_000_000, 5


def synthesise(clicks: DataFrame, requests: int = REQUESTS_PER_CLICK, impressions: int = IMPRESSIONS_PER_CLICK, seed: int = 11) -> DataFrame:
    """The funnel behind each click row ``(auction_id, campaign_id, uid, cost, conversion)``: its requests, impressions, the
    click, and a conversion if the flag is 1. All share the auction, each has its own identifier, and requests and
    impressions cost 0. Null campaign, conversion and cost count as 0. Row-local: nothing is shuffled."""
    flag = F.coalesce(F.col("conversion"), F.lit(0))
    many = lambda t, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit(t).alias("event_type"), i.cast("int").alias("nth")))
    steps = F.concat(many("request", F.lit(requests)), many("impression", F.lit(impressions)), many("click", F.lit(1)), F.when(flag == 1, many("conversion", F.lit(1))).otherwise(F.array().cast("array<struct<event_type:string,nth:int>>")))
    e = clicks.select("auction_id", F.coalesce("campaign_id", F.lit(0)).alias("campaign_id"), "uid", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.monotonically_increasing_id().alias("__row"), F.explode(steps).alias("s"))
    free = F.col("s.event_type").isin("request", "impression")
    digest = F.md5(F.concat_ws("/", F.lit(seed), "__row", "auction_id", "s.event_type", "s.nth"))
    return e.select(digest.alias("event_id"), "s.event_type", "auction_id", "campaign_id", "uid", F.when(free, 0.0).otherwise(F.col("cost")).alias("cost"))


CAMPAIGNS, BANNERS = 50, [(300, 250, 1), (728, 90, 3), (320, 50, 1)]
DEVICES = {1: ["android", "ios"], 2: ["windows", "macos", "linux"], 4: ["ios", "android"]}
SITES = ["news.example", "sports.example", "tech.example", "shop.example"]
COUNTRIES = ["KR", "US", "JP", "DE", "SG"]
START = 1_704_067_200


def drawn(name: str, row: Column, seed: int) -> Column:
    """A number from 0 to below 1 that follows from the name, the row's number and the seed alone."""
    digest = F.substring(F.md5(F.concat_ws("/", F.lit(name), F.lit(str(seed)), row.cast("string"))), 1, 7)
    return F.conv(digest, 16, 10).cast("double") / F.lit(268435456.0)


def random_funnel(
    spark: SparkSession, auctions: int, seed: int = 42, fill: float = FILL_RATE, ctr: float = CTR, cvr: float = CVR, per_second: float = 100.0, start: int = START, floors: tuple[float, float] = (0.25, 0.9)
) -> DataFrame:
    """Wire events of random auctions: a request always, each further step with its rate if the one before happened.

    All events of an auction share campaign, banner, device, site, user and bid, which is 1.2 to 1.8 times the campaign's
    floor price; each campaign has a floor of its own between ``floors``. ``per_second`` auctions share a second from
    ``start`` on, which is the pace at which a paced sink would send them. The same seed gives the same events. No
    auction, no event.
    """
    u = lambda name: drawn(name, F.col("id"), seed)
    pick = lambda name, n: F.floor(u(name) * n).cast("int")
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), k)
    a = spark.range(auctions).select(
        "id", (10_000_001 + pick("campaign", CAMPAIGNS)).alias("campaign_id"), pick("banner", len(BANNERS)).alias("b"), of(list(DEVICES), pick("device", len(DEVICES))).alias("device_type"),
        of(SITES, pick("site", len(SITES))).alias("site_domain"), of(SITE_CATEGORIES, pick("category", len(SITE_CATEGORIES))).alias("site_cat"), of(COUNTRIES, pick("country", len(COUNTRIES))).alias("country"),
        F.format_string("u_%07d", F.floor(u("user") * 1_000_000) + 1).alias("uid"), u("os").alias("os_draw"), u("premium").alias("premium"), u("fill").alias("r1"), u("ctr").alias("r2"), u("cvr").alias("r3"),
        (F.lit(start) + F.floor(F.col("id") / F.lit(per_second))).cast("bigint").alias("timestamp"), spelled(F.md5(F.concat_ws("/", F.lit("auction"), F.lit(str(seed)), F.col("id").cast("string")))).alias("auction_id"),
    )
    floor_price = F.round(F.lit(floors[0]) + drawn("floor", F.col("campaign_id"), seed) * (floors[1] - floors[0]), 2)
    systems = F.element_at(F.create_map(*(x for k, v in DEVICES.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("device_type"))
    a = a.withColumns({"floor_price": floor_price, "os": F.get(systems, F.floor(F.col("os_draw") * F.size(systems)).cast("int"))})
    a = a.withColumn("bid_price", F.round(F.col("floor_price") * (1.2 + F.col("premium") * 0.6), 4))
    for n, k in (("banner_w", 0), ("banner_h", 1), ("banner_pos", 2)):
        a = a.withColumn(n, of([x[k] for x in BANNERS], F.col("b")))
    imp = F.col("r1") < fill
    clk = imp & (F.col("r2") < ctr)
    steps = F.array_compact(F.array(F.lit("request"), F.when(imp, "impression"), F.when(clk, "click"), F.when(clk & (F.col("r3") < cvr), "conversion")))
    e = a.withColumn("event_type", F.explode(steps))
    made = {
        "event_id": spelled(F.md5(F.concat_ws("/", "auction_id", "event_type"))), "source": F.lit("dummy"), "banner_id": F.concat_ws("_", "campaign_id", "banner_w", "banner_pos"),
        "produced_at": F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    }
    return e.withColumns(made).select(*NATIVE_FIELDS)


def _uniform(name: str, lo: float, hi: float) -> Column:
    """A number between two bounds that follows from campaign, day and name alone."""
    digest = F.substring(F.md5(F.concat_ws("/", F.lit(name), F.col("campaign_id").cast("string"), F.date_format("event_date", "yyyy-MM-dd"))), 1, 7)
    return F.lit(lo) + F.conv(digest, 16, 10).cast("double") / F.lit(268435456.0) * F.lit(hi - lo)


def history(spark: SparkSession, last_day: str, days: int, base: int = SYNTHETIC_BASE, campaigns: int = SYNTHETIC_CAMPAIGNS) -> DataFrame:
    """Days of a healthy campaign mart: weekends at 60 %, a slight rise, steps that never exceed the one before."""
    d = spark.range(days * campaigns).select(F.floor(F.col("id") / campaigns).cast("int").alias("back"), (base + 1 + F.pmod("id", F.lit(campaigns))).cast("int").alias("campaign_id"))
    d = d.withColumn("event_date", F.date_sub(F.lit(last_day).cast("date"), F.col("back")))
    week = F.when(F.weekday("event_date") < 5, 1.0).otherwise(0.6)
    trend = F.lit(1.0) + (days - F.col("back")) * F.lit(0.004)
    d = d.withColumn("requests", F.floor(_uniform("requests", 40000, 80000) * week * trend))
    d = d.withColumn("impressions", F.floor(F.col("requests") * _uniform("fill", 0.75, 0.85)))
    d = d.withColumn("clicks", F.floor(F.col("impressions") * _uniform("ctr", 0.02, 0.03)))
    d = d.withColumn("conversions", F.floor(F.col("clicks") * _uniform("cvr", 0.03, 0.04)))
    d = d.withColumn("cost", F.round(F.col("clicks") * _uniform("click price", 0.3, 0.8), 2))
    return d.select(
        "campaign_id", "event_date", "requests", "impressions", "clicks", "conversions", ratio_or_zero("impressions", "requests", 4).alias("fill_rate"), ratio_or_zero("clicks", "impressions", 4).alias("ctr"),
        ratio_or_zero("conversions", "clicks", 4).alias("cvr"), "cost", ratio_or_zero("cost", "conversions", 2).alias("cpa"), ratio_or_zero(F.col("conversions") * REVENUE_PER_CONVERSION, "cost", 2).alias("roas"),
    )
