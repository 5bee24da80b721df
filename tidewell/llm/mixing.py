"""Mixing sources to target weights by hash-random order, distributed prefix sums and a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.tokens import token_count
from tidewell.session import materialise

SEED = 17
KEY_BITS = 60
#: Rows of a key range, about: sums of ranges are added up first, so that no more than that are sorted together.
ROWS_PER_RANGE = 65_536
#: Targets up to which the cuts (one row each) are sent to all tasks; beyond, they are joined like any table.
TARGETS_BROADCAST = 100_000


def sized(documents: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, n_tokens)``, counted once and written down."""
    return materialise(documents.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), token_count(text).alias("n_tokens")), "sized")


def _keyed(sizes: DataFrame, seed: int, bits: int) -> DataFrame:
    """``sizes`` with a hash-random ``key``, the same wherever it is computed, and its leading bits as ``range``."""
    key = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("doc_id").cast("string"), "source")), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    return sizes.withColumn("key", key).withColumn("range", F.shiftright("key", KEY_BITS - bits).cast("int"))


def range_bits(sizes: DataFrame) -> int:
    """Leading bits of the key that make ranges of about ``ROWS_PER_RANGE`` rows. The mix is the same for any number."""
    return min(24, max(4, (sizes.count() // ROWS_PER_RANGE).bit_length()))


def prefix_sums(sizes: DataFrame, seed: int, bits: int) -> DataFrame:
    """``(source, range, n, before)``: tokens of each key range of a source, and of all ranges before it."""
    sums = _keyed(sizes, seed, bits).groupBy("source", "range").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(sums.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "prefix-sums")


def cuts(sizes: DataFrame, targets: DataFrame, seed: int = SEED, bits: int | None = None) -> DataFrame:
    """One row for each target source: where the prefix sums of its documents, pass after pass, reach its budget.

    Columns: ``source, target_share, max_repeats, available, total, budget, passes, rest, short, cut, before, bits``.
    ``budget`` is the target share of the tokens of all documents, those of other or null sources included;
    ``available`` is where a source's prefix sums end. It is used ``passes`` times whole and then up to ``rest`` tokens
    of it once more, which falls into the key range ``cut``; ``short`` tells that the sums of ``max_repeats`` passes end
    before the budget. A null share or repeat counts as 0, a source without documents as 0 tokens; of a source listed
    several times the shares add up and the largest repeat counts; a null source matches no document.
    """
    bits = range_bits(sizes) if bits is None else bits
    sums = prefix_sums(sizes, seed, bits)
    ends = sums.groupBy("source").agg(F.max(F.col("before") + F.col("n")).alias("available"))
    total = ends.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total")).first()["total"]
    t = targets.groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("bigint").alias("max_repeats"))
    b = t.join(ends, "source", "left").select(*t.columns, F.coalesce("available", F.lit(0)).cast("bigint").alias("available"), F.lit(total).cast("bigint").alias("total"))
    b = b.withColumn("budget", F.col("target_share") * F.col("total"))
    full = F.floor(F.try_divide("budget", "available"))
    b = b.withColumn("passes", F.coalesce(F.least(full, F.col("max_repeats")), F.lit(0)).cast("bigint"))
    left = F.col("budget") - F.col("passes") * F.col("available")
    b = b.withColumns({"rest": F.when(F.col("passes") < F.col("max_repeats"), left).otherwise(0.0), "short": (F.col("passes") >= F.col("max_repeats")) & (left > 0) | (F.col("available") == 0) & (F.col("budget") > 0)})
    inside = b.select("source", "rest").join(sums, "source").where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    b = b.join(inside.select("source", F.col("range").alias("cut"), "before"), "source", "left")
    cut = F.when(F.col("rest") <= 0, -1).otherwise(F.coalesce("cut", F.lit(1 << bits)))
    return materialise(b.withColumns({"cut": cut, "bits": F.lit(bits)}), "cuts")


def mix(sizes: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, n_tokens, repeats)`` of the documents in the mix, by a ``plan`` from ``cuts``.

    Within a source documents stand in the order of a hash of their identifier. The last pass takes the longest run of
    them from the start that stays within ``rest`` tokens: the total misses the budget by less than one document. Only the
    rows of the key range that holds the cut are sorted and added up one by one, so a source may hold any part of all
    rows. Sources that are no target are left out.
    """
    first = plan.select("bits").first()
    plan = plan.select("source", "passes", "rest", "cut", "before")
    if plan.count() <= TARGETS_BROADCAST:
        plan = F.broadcast(plan)
    rows = _keyed(sizes, seed, first["bits"] if first else 4).join(plan, "source")
    outside = rows.where(F.col("range") != F.col("cut")).withColumn("repeats", F.col("passes") + (F.col("range") < F.col("cut")).cast("int"))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    inside = rows.where(F.col("range") == F.col("cut")).withColumn("repeats", F.col("passes") + (F.col("before") + running <= F.col("rest")).cast("int"))
    out = ["doc_id", "source", "n_tokens", "repeats"]
    return outside.select(*out).unionByName(inside.select(*out)).where(F.col("repeats") > 0)


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of each source of the mix."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    total = used.agg(F.sum("used").alias("t")).first()["t"] or 0
    share: Column = F.try_divide(F.coalesce(F.col("used"), F.lit(0)), F.lit(total))
    return plan.join(used, "source", "left").select(
        "source", "target_share", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("actual_share"), F.coalesce("used", F.lit(0)).cast("bigint").alias("used_tokens"),
        "available", "max_repeats", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).cast("bigint").alias("most_repeats"), "short"
    )
