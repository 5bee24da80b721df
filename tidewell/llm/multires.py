"""Distinct counts over sets too large to hold: multiresolution bitmaps.

Each identifier is hashed once to 64 bits. The number of trailing zeros of the hash picks one of ``LEVELS`` slices, so
that slice *i* holds about a 2^-(i+1) part of the identifiers; the top bits pick one of ``bits`` positions of that
slice's bitmap. Bitmaps are kept as rows of 64-bit words ``(keys, level, word, bits)``: two partial results merge by OR
of the words, whatever batch, file or day they come from, and a small set takes a few rows only.

Estimate: the lowest slice with at most ``FILL`` of its bits set is the base; linear counting over it and all slices
above, times 2^base. Saturated slices below are left out, so the relative error is the same at every scale.

Bound: with b bits a slice, sampling and linear counting together give a relative standard error of at most
1 / sqrt(b) (0.875 / b at the smallest load at which a slice is left out, 0.6 / b at the largest, as variances).
The result carries ``rel_error`` = 2 / sqrt(b), which about 95 % of estimates keep.

Ranges of days: OR is idempotent, so a range of any length is the OR of two overlapping blocks whose length is a power of
two. The blocks of each length come from those of half the length; a state of D days takes log2(D) times its rows.
Where every range is wanted, the state of one group goes to one task, which ORs its days from each first day on: D days
have D^2 / 2 ranges, and only their estimates leave the task, never their words.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise, shipped

BITS = 4096
LEVELS = 40
FILL = 1 - math.exp(-1.5)
BATCH = 1 << 16


def partial_bitmaps(df: DataFrame, value: str, keys: list[str], bits: int = BITS) -> DataFrame:
    """Mergeable state ``(keys..., level, word, bits)`` of the distinct non-null values per group of ``keys``."""
    h = F.col("__h")
    low = h.bitwiseAND(-h)
    level = F.least(F.bit_count(low - 1), F.lit(LEVELS - 1))
    level = F.when(h == 0, LEVELS - 1).otherwise(level)
    pos = F.shiftrightunsigned(h, 64 - int(math.log2(bits))).cast("int")
    hashed = df.where(F.col(value).isNotNull()).select(*keys, F.xxhash64(F.col(value).cast("string")).alias("__h0"))
    # the lowest hash has no negative; it is as good as any other
    hashed = hashed.withColumn("__h", F.when(F.col("__h0") == F.lit(-(2**63)), F.lit(1)).otherwise(F.col("__h0")))
    state = hashed.select(
        *keys, level.cast("int").alias("level"), F.shiftright(pos, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), pos.bitwiseAND(63)).alias("bit")
    )
    return state.groupBy(*keys, "level", "word").agg(F.bit_or("bit").alias("bits"))


def merge_bitmaps(state: DataFrame, keys: list[str]) -> DataFrame:
    """The state at the coarser ``keys``: OR of the words."""
    return state.groupBy(*keys, "level", "word").agg(F.bit_or("bits").alias("bits"))


def estimate(state: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """``(keys..., estimate, rel_error)`` from merged state. A group has at most LEVELS rows once its words are counted."""
    full = F.lit(bits * FILL)
    counted = state.groupBy(*keys, "level").agg(F.sum(F.bit_count("bits")).alias("ones"))
    # ones of a slice that has all bits set count as if one were left
    linear = -F.log(1 - F.least(F.col("ones"), F.lit(bits - 1)) / F.lit(float(bits))) * bits
    per = counted.select(*keys, "level", linear.alias("n"), F.when(F.col("ones") > full, F.col("level") + 1).otherwise(0).alias("base"))
    per = per.groupBy(*keys).agg(F.max("base").alias("base"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("slices"))
    base = F.least(F.col("base"), F.lit(LEVELS - 1))
    total = F.aggregate(
        F.map_entries("slices"), F.lit(0.0), lambda acc, x: acc + F.when(x["key"] >= base, x["value"]).otherwise(0.0)
    )
    return per.select(*keys, F.round(total * F.pow(F.lit(2.0), base)).cast("bigint").alias("estimate"), F.lit(2 / math.sqrt(bits)).alias("rel_error"))


def grouping(state: DataFrame, groups: list[list[str]], keys: list[str]) -> DataFrame:
    """The state merged to each set of keys of ``groups`` at once; ``grain`` names the set, keys outside it are null."""
    none = {k: F.lit(None).cast(state.schema[k].dataType) for k in keys}
    variants = F.array(
        *(F.struct(F.lit("+".join(g) or "all").alias("grain"), *((F.col(k) if k in g else none[k]).alias(k) for k in keys)) for g in groups)
    )
    wide = state.select(F.explode(variants).alias("g"), "level", "word", "bits")
    return merge_bitmaps(wide.select("g.*", "level", "word", "bits"), ["grain", *keys])


def days_of(state: DataFrame, day: str) -> tuple | None:
    """The first and last day of the state, or None; null days aside."""
    b = state.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    return (b["lo"], b["hi"]) if b["lo"] else None


def dyadic_blocks(state: DataFrame, day: str, group: str) -> DataFrame:
    """``(order, first_day, group, level, word, bits)``: daily state merged to the blocks of 2^order days from each day on
    that lie within the state's days. Rows of a null day are in no block."""
    now = state.where(F.col(day).isNotNull()).select(F.col(day).alias("first_day"), group, "level", "word", "bits")
    blocks, span = now.withColumn("order", F.lit(0)), days_of(state, day)
    if span is None:
        return blocks
    lo, hi = (F.lit(x) for x in span)
    for order in range(1, ((span[1] - span[0]).days + 1).bit_length()):
        half = 1 << (order - 1)
        twice = now.withColumn("first_day", F.explode(F.array("first_day", F.date_sub("first_day", half))))
        inside = (F.col("first_day") >= lo) & (F.date_add("first_day", 2 * half - 1) <= hi)
        now = materialise(merge_bitmaps(twice.where(inside), ["first_day", group]), "blocks")
        blocks = blocks.unionByName(now.withColumn("order", F.lit(order)))
    return blocks


def _ranges(wide: DataFrame, group: str) -> DataFrame:
    # all groups together from the state per group: words merge before they are copied again
    own = merge_bitmaps(wide, ["first_day", "last_day", group])
    whole = merge_bitmaps(own, ["first_day", "last_day"]).withColumn(group, F.lit(None).cast(wide.schema[group].dataType))
    return own.withColumn("grain", F.lit(f"range+{group}")).unionByName(whole.withColumn("grain", F.lit("range")))


def _estimates(ones: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """``estimate`` for a row of ``ones`` each: the bits set in the slices ``levels``."""
    n = -np.log(1 - np.minimum(np.arange(bits + 1), bits - 1) / bits) * bits
    base = np.minimum(np.where(ones > bits * FILL, levels + 1, 0).max(axis=1), LEVELS - 1)
    return np.floor(np.where(levels >= base[:, None], n[ones], 0.0).sum(axis=1) * 2.0**base + 0.5).astype(np.int64)


def _days_and_words(batches: Iterator[pa.RecordBatch], lo: int, hi: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The days of a group that have words, its words' slots, and the words by both."""
    days, slots, parts = np.zeros(hi - lo + 1, bool), np.zeros(LEVELS * width, bool), []
    for b in batches:
        day, slot, words = (b.column(c).to_numpy(zero_copy_only=False) for c in ("day", "slot", "bits"))
        days[day - lo], slots[slot] = True, True
        parts.append((day - lo, slot, words))
    row, column = np.cumsum(days) - 1, np.cumsum(slots) - 1
    table = np.zeros((days.sum(), slots.sum()), np.uint64)
    for day, slot, words in parts:
        table[row[day], column[slot]] = words.view(np.uint64)
    return np.flatnonzero(days) + lo, np.flatnonzero(slots), table


def _every_range(batches: Iterator[pa.RecordBatch], lo: int, hi: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First days, last days and estimates of the ranges within ``lo`` to ``hi`` that hold a day of the group."""
    width = max(1, bits // 64)
    days, slots, table = _days_and_words(batches, lo, hi, width)
    starts = np.flatnonzero(np.diff(slots // width, prepend=-1))
    levels = slots[starts] // width
    for i, day in enumerate(days):
        ones = np.add.reduceat(np.bitwise_count(np.bitwise_or.accumulate(table[i:], axis=0)), starts, axis=1, dtype=np.int64)
        last = np.arange(day, hi + 1)
        upto = _estimates(ones, levels, bits)[np.searchsorted(days[i:], last, side="right") - 1]
        # ranges that begin on a day without words, after the one before, are those from this day on
        for first in range(days[i - 1] + 1 if i else lo, day + 1):
            yield np.full(len(last), first), last, upto


def every_range(state: DataFrame, lo, hi, day: str, group: str, bits: int = BITS) -> DataFrame:
    """``(grain, first_day, last_day, group, estimate, rel_error)`` of every range of consecutive days between ``lo`` and
    ``hi``, whole and per group, from the state per day and group.

    A task takes the words of one group at a time, at most LEVELS * bits / 8 bytes a day however many rows there are.
    """
    kind, width = state.schema[group].dataType, max(1, bits // 64)
    own = state.where(F.col(day).isNotNull())
    whole = merge_bitmaps(own, [day]).withColumn(group, F.lit(None).cast(kind))
    both = own.withColumn("grain", F.lit(f"range+{group}")).unionByName(whole.withColumn("grain", F.lit("range")))
    both = both.select("grain", F.col(group).alias("of"), F.unix_date(day).alias("day"), (F.col("level") * width + F.col("word")).alias("slot"), "bits")
    first, end = ((x - dt.date(1970, 1, 1)).days for x in (lo, hi))

    def batch(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        a, b, n = (np.concatenate(x) for x in zip(*rows))
        dates = [pa.array(x.astype(np.int32)).view(pa.date32()) for x in (a, b)]
        return pa.RecordBatch.from_arrays([*(pa.repeat(k, len(n)) for k in key), *dates, pa.array(n)], ["grain", "of", "first_day", "last_day", "estimate"])

    def ranges(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for r in _every_range(batches, first, end, bits):
            rows.append(r)
            n += len(r[0])
            if n >= BATCH:
                yield batch(key, rows)
                rows, n = [], 0
        if rows:
            yield batch(key, rows)

    shipped(state.sparkSession)
    found = both.groupBy("grain", "of").applyInArrow(ranges, f"grain string, of {kind.simpleString()}, first_day date, last_day date, estimate bigint")
    return found.select("grain", "first_day", "last_day", F.col("of").alias(group), "estimate", F.lit(2 / math.sqrt(bits)).alias("rel_error"))


def range_counts(blocks: DataFrame, asked: DataFrame, group: str, bits: int = BITS) -> DataFrame:
    """``(grain, first_day, last_day, group, estimate, rel_error)`` of the asked ranges ``(first_day, last_day)``, however
    long, from ``dyadic_blocks``: an equality join with two blocks a range.

    Ranges may overlap, repeat and reach beyond the days there are; one that holds no day of the state has no row, nor
    has one that ends before it begins or lacks a bound.
    """
    span = days_of(blocks.where("`order` = 0"), "first_day")
    keys = ["grain", "first_day", "last_day", group]
    if span is None:
        return estimate(_ranges(blocks.withColumns({"last_day": F.col("first_day")}), group), keys, bits)
    lo, hi = (F.lit(x) for x in span)
    r = asked.select("first_day", "last_day").where("first_day <= last_day").distinct()
    r = r.withColumns({"__a": F.greatest("first_day", lo), "__b": F.least("last_day", hi)}).where(F.col("__a") <= F.col("__b"))
    order = F.floor(F.log2(F.datediff("__b", "__a") + 1 + F.lit(1e-9))).cast("int")
    r = r.withColumn("order", order)
    starts: Column = F.array_distinct(F.array("__a", F.expr("date_add(__b, 1 - shiftleft(1, `order`))")))
    r = r.select("first_day", "last_day", "order", F.explode(starts).alias("__start"))
    b = blocks.withColumnRenamed("first_day", "__start")
    return estimate(_ranges(b.join(r, ["order", "__start"]), group), keys, bits)


def distinct_counts(df: DataFrame, value: str, day: str, group: str, bits: int = BITS) -> DataFrame:
    """``(grain, first_day, last_day, group, estimate, rel_error)``: per day, per group, per both, over all, and for every
    range of consecutive days, whole and per group.

    The rows are read once; all else comes from the partial results per day and group, which are written down. Rows with null
    ``value`` add nothing, and a group of nothing but nulls has no row; null days and groups are groups of their own
    (``grain`` tells them from "every"), null days are in no range. An empty table gives no row. Repeated rows change
    nothing. The number of ranges grows with the square of the days; ``range_counts`` answers single ones.
    """
    state = materialise(partial_bitmaps(df, value, [day, group], bits), "bitmaps")
    grains = grouping(state, [[], [day], [group], [day, group]], [day, group])
    grains = grains.select("grain", F.col(day).alias("first_day"), F.col(day).alias("last_day"), group, "level", "word", "bits")
    counts, span = estimate(grains, ["grain", "first_day", "last_day", group], bits), days_of(state, day)
    return counts if span is None else counts.unionByName(every_range(state, *span, day, group, bits))


def errors(df: DataFrame, value: str, day: str, group: str, bits: int = BITS) -> DataFrame:
    """``(grain, n_groups, exact_total, within_bound)``: estimates beside exact counts, for each grain but ranges.

    ``within_bound``: at least 95 % of the groups are within 1.5 times ``rel_error``, which is three standard errors.
    """
    keys = ["grain", day, group]
    state = partial_bitmaps(df, value, [day, group], bits)
    groups = [[], [day], [group], [day, group]]
    about = estimate(grouping(state, groups, [day, group]), keys, bits)
    rows = df.where(F.col(value).isNotNull()).select(day, group, F.col(value).alias("__v")).distinct()
    none = {k: F.lit(None).cast(df.schema[k].dataType) for k in (day, group)}
    sets = F.array(*(F.struct(F.lit("+".join(g) or "all").alias("grain"), *((F.col(k) if k in g else none[k]).alias(k) for k in (day, group))) for g in groups))
    exact = rows.select(F.explode(sets).alias("g"), "__v").select("g.*", "__v").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("exact"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    both = exact.alias("e").join(about.alias("a"), same, "left").select("e.grain", "e.exact", "a.estimate", "a.rel_error")
    near = F.coalesce(F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(0.5), F.col("exact") * F.col("rel_error") * 1.5), F.lit(False))
    return both.groupBy("grain").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("exact").alias("exact_total"), (F.count_if(near) >= 0.95 * F.count(F.lit(1))).alias("within_bound"))
