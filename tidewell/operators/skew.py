"""Per-key results when a few keys hold most records: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
SUSPECT_SHARE = 0.005
SKETCH_ITEMS = 2000


def suspects(df: DataFrame, keys: tuple[str, ...], share: float = SUSPECT_SHARE, items: int = SKETCH_ITEMS) -> tuple[dict[str, list[str]], int]:
    """For each key column the values (as strings) that may hold more than ``share`` of the rows, from mergeable
    frequent-items sketches, and the number of all rows: one scan for all columns.

    At most ``1 / share`` values a column plus the sketch's error reach the driver. They only decide where salt is added,
    so a missed or superfluous suspect changes no result.
    """
    sketch = lambda k: F.expr(f"approx_top_k(cast(`{k}` as string), {min(items, int(2 / share))}, {items * 4}) FILTER (WHERE `{k}` IS NOT NULL)")
    top = df.agg(*(sketch(k).alias(f"top_{n}") for n, k in enumerate(keys)), F.count(F.lit(1)).alias("n")).first()
    return {k: [x["item"] for x in top[f"top_{n}"] or [] if x["count"] > share * top["n"]] for n, k in enumerate(keys)}, top["n"]


def _salt(name: Column, heavy: list[str], salts: int, seed: int) -> Column:
    hot = name.isNull() | name.isin(heavy) if heavy else name.isNull()
    return F.when(hot, F.floor(F.rand(seed) * salts).cast("int")).otherwise(F.lit(0))


def salted_aggregate(
    df: DataFrame, key: str, partial: dict[str, Column], merge: dict[str, Column], heavy: list[str] | None = None, salts: int = SALTS, seed: int = 7
) -> DataFrame:
    """``merge`` per ``key`` over the ``partial`` results of each salt.

    Rows of heavy keys get a random salt, so that up to ``salts`` tasks share such a key; others get salt 0 and stay
    whole. ``partial`` names the first stage's aggregates, ``merge`` combines those names. The key comes out as string;
    null keys form a group of their own, salted as well. The salt is seeded, and drawn right above the scan, so that a
    task run again draws the same.
    """
    heavy = suspects(df, (key,))[0][key] if heavy is None else heavy
    name = F.col(key).cast("string")
    first = df.withColumn("__salt", _salt(name, heavy, salts, seed)).withColumn("__key", name).groupBy("__key", "__salt").agg(*(c.alias(n) for n, c in partial.items()))
    return first.groupBy(F.col("__key").alias("key_value")).agg(*(c.alias(n) for n, c in merge.items()))


def heavy_keys(df: DataFrame, keys: tuple[str, ...], share: float = 0.02, salts: int = SALTS, seed: int = 7) -> DataFrame:
    """``(key_column, key_value, n_rows, share)`` of each non-null value held by more than ``share`` of all rows.

    Exact: the counts are those of the salted aggregation over every row, null keys included in the total. One scan
    suspects, a second counts all key columns at once. An empty table has no heavy key.
    """
    heavy, total = suspects(df, keys)
    one = lambda n, k: F.struct(F.lit(k).alias("key_column"), F.col(k).cast("string").alias("key_value"), _salt(F.col(k).cast("string"), heavy[k], salts, seed + n).alias("salt"))
    rows = df.select(F.explode(F.array(*(one(n, k) for n, k in enumerate(keys)))).alias("k")).select("k.*").where(F.col("key_value").isNotNull())
    counted = rows.groupBy("key_column", "key_value", "salt").agg(F.count(F.lit(1)).alias("n")).groupBy("key_column", "key_value").agg(F.sum("n").alias("n_rows"))
    part = F.try_divide(F.col("n_rows"), F.lit(total))
    return counted.where(F.col("n_rows") > F.lit(total) * F.lit(share)).select("key_column", "key_value", "n_rows", part.alias("share"))


def funnel_by_key(events: DataFrame, key: str) -> DataFrame:
    """Funnel counts, other rows and click cost for each value of ``key``, by salted aggregation.

    Null costs count as 0 and a null key is a group of its own.
    """
    steps = {"requests": "request", "impressions": "impression", "clicks": "click", "conversions": "conversion"}
    partial = {n: F.count_if(F.col("event_type") == t) for n, t in steps.items()}
    partial |= {"n_rows": F.count(F.lit(1)), "cost": F.sum(F.when(F.col("event_type") == "click", F.coalesce("cost", F.lit(0.0))).otherwise(0.0))}
    merge = {n: F.sum(n) for n in partial if n != "cost"} | {"cost": F.round(F.sum("cost"), 4)}
    return salted_aggregate(events, key, partial, merge)
