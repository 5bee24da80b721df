"""Declared schemas and constants of the advertising funnel."""

from __future__ import annotations

# fixed values: wire schemas of the two event producers
NATIVE_FIELDS = {
    "event_id": "string",
    "event_type": "string",
    "source": "string",
    "auction_id": "string",
    "campaign_id": "int",
    "banner_id": "string",
    "banner_w": "int",
    "banner_h": "int",
    "banner_pos": "int",
    "site_domain": "string",
    "site_cat": "string",
    "device_type": "int",
    "os": "string",
    "country": "string",
    "uid": "string",
    "floor_price": "double",
    "bid_price": "double",
    "timestamp": "bigint",
    "produced_at": "string",
}
REPLAY_FIELDS = {
    "event_id": "string",
    "event_type": "string",
    "source": "string",
    "auction_id": "string",
    "produced_at": "string",
    "uid": "string",
    "campaign": "int",
    "conversion": "int",
    "cost": "double",
    "timestamp": "bigint",
} | {f"cat{i}": "bigint" for i in range(1, 10)}
WIRE = {"dummy": NATIVE_FIELDS, "criteo": REPLAY_FIELDS}

# fixed values: funnel steps, site categories, epoch of the replayed data set
EVENT_TYPES = ["request", "impression", "click", "conversion"]
SITE_CATEGORIES = ["IAB1", "IAB2", "IAB3", "IAB4", "IAB5", "IAB7", "IAB9", "IAB13"]
REPLAY_EPOCH = 1_704_067_200
REVENUE_PER_CONVERSION = 10.0
REQUESTS_PER_CLICK, IMPRESSIONS_PER_CLICK = 50, 40
FILL_RATE, CTR, CVR = 0.80, 0.025, 0.035


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {v}" for k, v in fields.items())


BRONZE = (
    "key string, value string, topic string, kafka_partition int, kafka_offset bigint,"
    " kafka_timestamp timestamp, ingested_at timestamp, dt string, hour int"
)
BRONZE_PARTITION = ["dt", "hour"]
SILVER = (
    "event_id string, event_type string, source string, auction_id string, campaign_id int,"
    " event_timestamp timestamp, event_date date, uid string, banner_id string, site_cat string,"
    " device_type int, os string, country string, cost double, conversion int,"
    " conversion_delay_sec bigint, updated_at timestamp"
)
SILVER_COLUMNS = [x.split()[0] for x in SILVER.split(",")]


def topic_of(event_type: str) -> str:
    return f"ad-{event_type}s"


def bronze_table_of(topic: str) -> str:
    return topic.replace("-", "_")
