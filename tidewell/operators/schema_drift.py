"""Schemas that drift: headers read in parallel, folded through a type lattice, one union table, an ordered change log.

The header of a JSON message is the list of its names and the JSON type of each; the header of a Parquet file is its
footer. Messages of one header are told apart no further: each is parsed where it is, and what leaves the scan is one row
for each day, source and header, with the number of its messages. Types are bits, so that folding any number of headers
is one OR per source and field. ``promote`` maps a set of bits to the least type that holds all of them.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.ids import json_object
from tidewell.session import materialise, shipped

#: JSON types as bits of the lattice.
BIT = {"null": 1, "boolean": 2, "number": 4, "string": 8, "object": 16, "array": 32}
#: Numbers that an int doesn't hold: whole ones up to 2^53 and beyond, fractions, and those that no double gives back.
LONG, HUGE, FRACTION, WIDE = 64, 128, 256, 512
#: JSON type of a declared type.
JSON_OF = {"string": "string", "int": "number", "bigint": "number", "double": "number", "boolean": "boolean"}

# a new name is taken for a declared one if the declared one is absent where it stands and their contents look alike
ABSENT_SHARE, INSIDE_SHARE, OVERLAP, SURE_OVERLAP = 0.95, 0.8, 0.3, 0.5
#: Values tell contents apart if two of them, drawn by chance, are equal so often.
REPEATS = 1 / 256
#: Places of a declared field that the union table looks into; what stands at rarer ones stays in ``rest``.
PLACES = 32


def kind_of(v: Column) -> Column:
    """The JSON type of a variant, by the first two letters of its SQL type; null for what is absent."""
    names = {"VO": "null", "ST": "string", "BO": "boolean", "OB": "object", "AR": "array"} | dict.fromkeys(("BI", "DE", "DO", "FL"), "number")
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.try_element_at(table, F.substring(F.schema_of_variant(v), 1, 2))


def bits_of(v: Column) -> Column:
    """The bit of a variant's JSON type, with that of a number's size beside it. Texts, whole numbers and short fractions,
    which are nearly all there is, are told by their SQL type."""
    kind, text, sql = kind_of(v), F.try_variant_get(v, "$", "string"), F.schema_of_variant(v)
    size = lambda n: F.when(n.between(-(2**31), 2**31 - 1), 0).when(n.between(-(2**53), 2**53), LONG).otherwise(HUGE)
    whole, plain = text.try_cast("bigint"), text.try_cast("decimal(38,20)")
    exact = (F.length(F.regexp_extract(text, r"\.(\d+)$", 1)) <= 20) & (plain == text.try_cast("double").try_cast("decimal(38,20)"))
    number = F.when(whole.isNotNull(), size(whole)).when(sql.isin("DOUBLE", "FLOAT") | exact, FRACTION).otherwise(WIDE)
    other = functools.reduce(lambda c, k: c.when(kind == k, BIT[k]), ("boolean", "object", "array"), F.when(kind == "null", BIT["null"]))
    return (
        F.when(sql == "STRING", BIT["string"])
        .when(sql == "BIGINT", F.lit(BIT["number"]).bitwiseOR(size(F.try_variant_get(v, "$", "bigint"))))
        .when(sql.startswith("DECIMAL") & (F.length(text) <= 16) & text.contains("."), BIT["number"] | FRACTION)
        .when(kind == "number", F.lit(BIT["number"]).bitwiseOR(number))
        .otherwise(other)
    )


def promote(bits: Column, declared: Column | str = "string") -> Column:
    """The least type that holds every value in ``bits``; nothing but nulls keeps the declared type, and numbers one
    that holds them."""
    declared = F.lit(declared) if isinstance(declared, str) else declared
    kinds, sizes = bits.bitwiseAND(~1 & (LONG - 1)), bits.bitwiseAND(LONG | HUGE | FRACTION | WIDE)
    has = lambda size: sizes.bitwiseAND(size) != 0
    broken = has(FRACTION) | (declared == "double")
    number = (
        F.when((declared == "string") | has(WIDE) | (broken & has(HUGE)), "string")
        .when(broken, "double")
        .when((sizes != 0) | (declared == "bigint"), "bigint")
        .otherwise("int")
    )
    return (
        F.when(kinds == 0, declared)
        .when(kinds == BIT["boolean"], "boolean")
        .when(kinds == BIT["number"], number)
        .when(kinds == BIT["array"], "array<variant>")
        .otherwise("string")
    )


def _parsed(messages: DataFrame, wire: dict[str, dict[str, str]], value: str, source: str = "source") -> DataFrame:
    """Messages with ``v`` (variant), ``src``, ``names``, ``absent``, ``extra``; ``reason`` tells why one has no header:
    ``broken`` or ``undeclared source``. An object that repeats a name is broken here."""
    v = messages.withColumn("v", json_object(value))
    src = F.try_variant_get("v", f"$.{source}", "variant")
    known = F.coalesce((kind_of(src) == "string") & F.try_variant_get("v", f"$.{source}", "string").isin(*wire), F.lit(False))
    reason = F.when(F.col("v").isNull(), "broken").when(~known, "undeclared source")
    v = v.withColumns({"reason": reason, "src": F.when(known, F.try_variant_get("v", f"$.{source}", "string")), "names": F.json_object_keys(value)})
    declared = _by_source(wire, lambda fields: F.array(*map(F.lit, fields)))
    return v.withColumns({"absent": F.array_except(declared, "names"), "extra": F.array_except("names", declared)})


def headers(messages: DataFrame, wire: dict[str, dict[str, str]], value: str = "value", source: str = "source", day: str = "dt") -> DataFrame:
    """``(dt, src, head, n, v, absent, extra)``: the headers of the declared sources' messages by day, written down.

    ``head`` is the header as text, ``n`` the number of its messages, ``v`` one of them, which stands for the names and
    types of all. Rows whose value isn't one valid JSON object, or names another source, are left out.
    """
    p = _parsed(messages.select(F.col(day).alias("dt"), F.col(value).alias("raw")), wire, "raw", source)
    head = F.when(F.col("reason").isNull(), F.regexp_replace(F.schema_of_variant("v"), r"DECIMAL\(\d+,\d+\)", "DECIMAL"))
    h = p.groupBy("dt", "src", head.alias("head")).agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(F.when(F.col("reason").isNull(), F.col("v")).alias("v"), "absent", "extra")).alias("one"))
    # those without header are one group a day, left out here: a filter before would parse twice
    return materialise(h.select("dt", "src", "head", "n", "one.*").where(F.col("v").isNotNull()), "headers")


def _by_source(wire: dict, make) -> Column:
    return functools.reduce(lambda c, s: c.when(F.col("src") == s, make(wire[s])), list(wire)[1:], F.when(F.col("src") == next(iter(wire)), make(wire[next(iter(wire))])))


def _places(extra: Column, v: Column) -> Column:
    """The undeclared places of a message, as an array: ``top``, ``leaf`` (of an object's members, else null), ``val``."""
    entries = lambda x: F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
    place = lambda top, leaf, val: F.struct(top.alias("top"), leaf.alias("leaf"), val.alias("val"))
    none = F.lit(None).cast("string")
    inner = lambda e: F.when(kind_of(e["value"]) == "object", F.transform(entries(e["value"]), lambda i: place(e["key"], i["key"], i["value"])))
    tops = F.filter(entries(v), lambda e: F.array_contains(extra, e["key"]))
    each = F.transform(tops, lambda e: F.concat(F.array(place(e["key"], none, e["value"])), F.coalesce(inner(e), F.array().cast("array<struct<top:string,leaf:string,val:variant>>"))))
    return F.when(F.size(extra) > 0, F.flatten(each))


def _feature(kind: Column, text: Column) -> Column:
    """What a value looks like: its kind, with a bounded number of classes by value, by shape and by magnitude."""
    shape = F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "a"), r"\d+", "9")
    size = F.floor(F.log2(F.abs(text.try_cast("double")) + F.lit(1e-9)) * 2)
    return F.array(
        F.concat(F.lit("v:"), kind, F.pmod(F.xxhash64(text), F.lit(1024)).cast("string")),
        F.when(kind == "number", F.concat(F.lit("n:"), size.cast("string"))).otherwise(F.concat(F.lit("s:"), kind, F.pmod(F.xxhash64(shape), F.lit(64)).cast("string"))),
    )


def renames(h: DataFrame, messages: DataFrame, wire: dict[str, dict[str, str]], value: str = "value") -> DataFrame:
    """Declared fields found under another name or place: ``(src, top, leaf, name, n)``, one row for each such place.

    Evidence is counted over all messages: (1) from headers alone, the declared name is absent nearly everywhere the new
    place is filled; (2) the contents look alike: the values, or where those are too many to repeat, their magnitudes or
    shapes, of the new place lie where those of the declared name lie. Shares are held against thresholds with the
    sampling error of the number of values behind them. Contents are read in one scan, and counted by class; only the
    declared names in question reach the driver.
    """
    key = ["src", "top", "leaf"]
    there = h.select("src", "absent", "n", F.explode(_places(F.col("extra"), F.col("v"))).alias("p")).select("src", "p.top", "p.leaf", "absent", "n")
    filled = there.groupBy(*key).agg(F.sum("n").alias("n"))
    pairs = there.select(*key, "n", F.explode("absent").alias("name")).groupBy(*key, "name").agg(F.sum("n").alias("without"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    pairs = pairs.alias("l").join(filled.alias("r"), same).where(F.col("without") >= ABSENT_SHARE * F.col("n")).select("l.*", "n")
    missing = h.select("src", "n", F.explode("absent").alias("name")).groupBy("src", "name").agg(F.sum("n").alias("missing"))
    pairs = materialise(pairs.join(missing, ["src", "name"]), "pairs")
    wanted: dict[str, list[str]] = {}
    for r in pairs.select("src", "name").distinct().collect():  # declared names only
        wanted.setdefault(r["src"], []).append(r["name"])
    if not wanted:
        return h.sparkSession.createDataFrame([], "src string, top string, leaf string, name string, n bigint")

    p = _parsed(messages.select(F.col(value).alias("raw")), wire, "raw")
    own = _by_source(wanted, lambda f: F.array(*(F.struct(F.lit(None).cast("string").alias("top"), F.lit(None).cast("string").alias("leaf"), F.lit(x).alias("name"), F.try_variant_get("v", f"$.{x}", "variant").alias("val")) for x in f)))
    new = F.transform(_places(F.col("extra"), F.col("v")), lambda x: F.struct(x["top"].alias("top"), x["leaf"].alias("leaf"), F.lit(None).cast("string").alias("name"), x["val"].alias("val")))
    own = F.filter(own, lambda x: x["val"].isNotNull())
    c = p.select("src", F.explode(F.flatten(F.array_compact(F.array(own, new)))).alias("o")).select("src", "o.*")
    c = c.select(*key, "name", F.nullif(kind_of(F.col("val")), F.lit("null")).alias("kind"), F.col("val").cast("string").alias("text"))
    classes = c.select(*key, "name", F.explode(_feature(F.col("kind"), F.col("text"))).alias("f")).where(F.col("f").isNotNull()).groupBy(*key, "name", "f").agg(F.count(F.lit(1)).alias("c"))
    classes = materialise(classes.withColumn("side", F.substring("f", 1, 1)), "classes")

    new, old = classes.where(F.col("name").isNull()).drop("name"), classes.where(F.col("name").isNotNull()).drop("top", "leaf")
    totals_new = new.groupBy(*key, "side").agg(F.sum("c").alias("t_new"))
    totals_old = old.groupBy("src", "name", "side").agg(F.sum("c").alias("t_old"), F.sum(F.col("c") * (F.col("c") - 1)).alias("equal"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    j = pairs.alias("l").join(new.alias("r"), same).select("l.*", "r.f", "r.side", "r.c")
    j = j.join(old.withColumnRenamed("c", "c_old"), ["src", "name", "f", "side"], "left")
    j = j.join(totals_old, ["src", "name", "side"])
    # values tell only where they repeat
    j = j.where((F.col("side") != "v") | (F.col("equal") >= REPEATS * F.col("t_old") * (F.col("t_old") - 1)) & (F.col("equal") > 0))
    j = j.alias("l").join(totals_new.alias("r"), [*same, F.col("l.side") == F.col("r.side")]).select("l.*", "r.t_new")
    within = F.when(F.col("c_old") >= F.col("t_old") * 0.0005, F.col("c") / F.col("t_new")).otherwise(0.0)
    meet = F.least(F.col("c") / F.col("t_new"), F.coalesce(F.col("c_old"), F.lit(0)) / F.col("t_old"))
    # t_new values over so many classes differ from the distribution they come from by about this much
    error = 0.4 * F.sqrt(F.col("t_old") * F.col("t_old") / F.col("squares") / F.col("t_new"))
    sides = j.groupBy(*key, "name", "n", "without", "missing", "side").agg(F.sum(within).alias("inside"), F.sum(meet).alias("overlap"), F.first(error).alias("error"))
    per = sides.groupBy(*key, "name", "n", "without", "missing").agg(F.max_by(F.struct("inside", "overlap", "error"), F.when(F.col("side") == "v", 1).otherwise(0)).alias("s"))
    # a member of a new object counts as a declared field only under the declared name, or with plainly the same content
    leaf_ok = F.col("leaf").isNull() | (F.col("leaf") == F.col("name")) | (F.col("s.overlap") - F.col("s.error") >= SURE_OVERLAP)
    both_ways = F.col("without") >= ABSENT_SHARE * F.col("missing")  # values that move with time overlap little
    alike = (F.col("s.inside") >= INSIDE_SHARE) & ((F.col("s.overlap") + F.col("s.error") >= OVERLAP) | both_ways)
    best = F.max_by(F.struct("name", "n"), F.struct(F.coalesce(F.col("leaf") == F.col("name"), F.lit(False)), "s.overlap", "without", "name"))
    return materialise(per.where(alike & leaf_ok).groupBy(*key).agg(best.alias("b")).select(*key, "b.name", "b.n"), "renames")


def fold_days(h: DataFrame, wire: dict[str, dict[str, str]]) -> DataFrame:
    """``(dt, src, name, bits, n_<kind>...)``: each day's schema of each source, its headers folded through the lattice."""
    kinds = _by_source(wire, lambda fields: F.array(*(F.struct(F.lit(n).alias("name"), kind_of(F.try_variant_get("v", f"$.{n}", "variant")).alias("kind")) for n in fields)))
    each = h.select("dt", "src", "n", F.explode(kinds).alias("k")).select("dt", "src", "n", "k.name", "k.kind").where(F.col("kind").isNotNull())
    bit = F.element_at(F.create_map(*(F.lit(x) for pair in BIT.items() for x in pair)), F.col("kind"))
    return each.groupBy("dt", "src", "name").agg(F.bit_or(bit).alias("bits"), *(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in BIT))


def changes(h: DataFrame, wire: dict[str, dict[str, str]], moved: DataFrame) -> DataFrame:
    """The change log ``(dt, source, change_kind, field_name, found_as, n_messages)`` of headers ``h``: where each day's
    folded schema, and the names of its headers, differ from the declared ones."""
    key = ["dt", "src", "head"]
    there = h.select(*key, "absent", F.explode(_places(F.col("extra"), F.col("v"))).alias("p")).select(*key, "absent", "p.top", "p.leaf")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("src", "top", "leaf")]
    there = there.alias("l").join(moved.alias("r"), same).select("l.*", "r.name").where(F.array_contains("absent", F.col("name")))
    moves = there.groupBy(*key).agg(F.collect_set(F.struct("name", "top", F.concat_ws(".", "top", "leaf").alias("place"))).alias("moves"))
    h = h.alias("h").join(moves.alias("m"), [F.col(f"h.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key], "left").select("h.*", "m.moves")
    h = h.withColumn("moves", F.coalesce("moves", F.array().cast("array<struct<name:string,top:string,place:string>>")))

    def log(kind: str, names: Column) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("change_kind"), x.alias("field_name"), F.lit(None).cast("string").alias("found_as")))

    renamed = F.transform("moves", lambda m: F.struct(F.lit("renamed").alias("change_kind"), m["name"].alias("field_name"), m["place"].alias("found_as")))
    gone = F.array_except("absent", F.transform("moves", lambda m: m["name"]))
    every = F.concat(renamed, log("removed", gone), log("added", F.array_except("extra", F.transform("moves", lambda m: m["top"]))))
    rows = h.select("dt", F.col("src").alias("source"), "n", F.explode(every).alias("c")).select("dt", "source", "c.*", "n")
    declared = _by_source(wire, lambda fields: F.element_at(F.create_map(*(x for n, t in fields.items() for x in (F.lit(n), F.lit(BIT[JSON_OF[t]])))), F.col("name")))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.lit(BIT[k]).alias("bit")) for k in BIT if k != "null"))
    other = F.filter(kinds, lambda x: (F.col("bits").bitwiseAND(x["bit"]) != 0) & (x["bit"] != declared))
    retyped = fold_days(h, wire).select("dt", F.col("src").alias("source"), F.lit("retyped").alias("change_kind"), F.col("name").alias("field_name"), F.explode(other).alias("k"))
    rows = rows.unionByName(retyped.select("dt", "source", "change_kind", "field_name", F.col("k.kind").alias("found_as"), "k.n"))
    return rows.groupBy("dt", "source", "change_kind", "field_name", "found_as").agg(F.sum("n").alias("n_messages"))


def drift_report(messages: DataFrame, wire: dict[str, dict[str, str]], value: str = "value") -> DataFrame:
    """Every change of every day, source and field, in order of day. Null or broken values show no change."""
    h = headers(messages, wire, value)
    return changes(h, wire, renames(h, messages, wire, value)).orderBy("dt", "source", "change_kind", "field_name", "found_as")


def day_schemas(messages: DataFrame, wire: dict[str, dict[str, str]], value: str = "value") -> DataFrame:
    """``(dt, source, field_name, json_type)``: the least type of the lattice for each declared field that came that day;
    ``null`` if nothing but nulls did."""
    f = fold_days(headers(messages, wire, value), wire)
    kinds = F.col("bits").bitwiseAND(~1)
    one = functools.reduce(lambda c, k: c.when(kinds == BIT[k], k), list(BIT)[1:], F.when(kinds == 0, "null"))
    return f.select("dt", F.col("src").alias("source"), F.col("name").alias("field_name"), one.otherwise("string").alias("json_type"))


def _moved(m: dict) -> Column:
    """The value that stands at a new place instead of its declared field; null where the message has the field itself."""
    path = f"$['{m['top']}']" + (f"['{m['leaf']}']" if m["leaf"] else "")
    here = (F.col("src") == m["src"]) & F.array_contains("absent", m["name"]) & F.array_contains("extra", m["top"])
    return F.when(here, F.try_variant_get("v", path, "variant"))


def _value(n: str, moved: list[dict]) -> Column:
    """The declared field's value, by its own or its new name, as variant."""
    places = [F.try_variant_get("v", f"$.{n}", "variant"), *(_moved(m) for m in moved if m["name"] == n)]
    return functools.reduce(lambda a, b: F.when(a.isNull(), b).otherwise(a), places)


def fold(h: DataFrame, wire: dict[str, dict[str, str]], moved: list[dict]) -> DataFrame:
    """The lattice: ``(src, name, bits)``, the OR of the types of each declared field over all messages."""
    values = _by_source(wire, lambda fields: F.array(*(F.struct(F.lit(n).alias("name"), _value(n, moved).alias("val")) for n in fields)))
    each = h.select("src", F.explode(values).alias("o")).select("src", "o.name", "o.val").where(F.col("val").isNotNull())
    return each.groupBy("src", "name").agg(F.bit_or(bits_of(F.col("val"))).alias("bits"))


def _rest(moved: list[dict]) -> Column:
    """JSON text by name of what no declared field takes. An object is whole, though one of its members be taken."""
    taken, before = [], {}
    for m in moved:
        here = _moved(m).isNotNull()
        earlier = before.setdefault((m["src"], m["name"]), [])
        if not m["leaf"]:
            taken.append(F.when(functools.reduce(operator.and_, (~e for e in earlier), here), F.lit(m["top"])))
        earlier.append(here)
    left = F.array_except("extra", F.array_compact(F.array(*taken))) if taken else F.col("extra")
    every = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: F.array_contains(left, k))
    return F.when(F.size(left) > 0, F.transform_values(every, lambda _, x: F.to_json(x)))


def union_table(messages: DataFrame, wire: dict[str, dict[str, str]], value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages as one table: every declared field of every source, found by its own or its new name.

    A field has the least type of the lattice that holds its declared type's numbers and all that came, wherever it
    came from: numbers that don't fit widen it, mixed kinds make it text, so that no content is lost. A field of two
    sources takes the wider of both. ``rest`` maps the names that no declared field takes to their JSON. Every message
    has its row: one that is broken or of an undeclared source has no fields, a ``reject_reason`` and its text as
    ``reject_value``. The columns of ``keep`` come along under their names, prefixed with ``msg_`` where they clash.
    """
    along = [F.struct(*keep).alias("__keep")] if keep else []  # apart, as their names may be any
    source = messages.select(F.col(value).alias("raw"), *along)
    found = renames(headers(source.withColumn("dt", F.lit("")), wire, "raw"), source, wire, "raw")
    often = F.row_number().over(Window.partitionBy("src", "name").orderBy(F.desc("n"), "top", "leaf"))
    moved = [r.asDict() for r in found.withColumn("k", often).where(F.col("k") <= PLACES).orderBy("src", "name", "k").collect()]  # so many for a declared name
    every = materialise(_parsed(source, wire, "raw").drop("names").withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw"))), "parsed")
    h = every.where(F.col("reason").isNull())
    names = list(dict.fromkeys(n for f in wire.values() for n in f))
    order = ["boolean", "int", "bigint", "double", "string"]
    widest = {n: max((f[n] for f in wire.values() if n in f), key=order.index) for n in names}
    declared = F.create_map(*(F.lit(x) for pair in widest.items() for x in pair))
    folded = fold(h, wire, moved).groupBy("name").agg(F.bit_or("bits").alias("bits"))
    types = widest | {r["name"]: r["type"] for r in folded.select("name", promote(F.col("bits"), F.element_at(declared, F.col("name"))).alias("type")).collect()}  # a row for each declared field

    def column(n: str) -> Column:
        owners = [s for s, f in wire.items() if n in f]
        v, t = F.when(F.col("src").isin(*owners), _value(n, moved)), types[n]
        return F.try_variant_get(v, "$", t).alias(n)

    others = [_rest(moved).alias("rest"), F.col("reason").alias("reject_reason"), F.col("raw").alias("reject_value")]
    taken = {*names, "rest", "reject_reason", "reject_value"}
    return every.select(*(column(n) for n in names), *(F.col(f"__keep.{c}").alias(f"msg_{c}" if c in taken else c) for c in keep), *others)


# --- Parquet files ---------------------------------------------------------------------------------------------------

#: Widening order of file types; types of different chains meet in string.
CHAINS = (("bool",), ("int8", "int16", "int32", "int64", "double"), ("float", "double"), ("date32[day]", "timestamp[us]"))
SPARK_OF = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float", "double": "double", "date32[day]": "date", "timestamp[us]": "timestamp_ntz", "timestamp[us, tz=UTC]": "timestamp", "string": "string", "null": "void"}


def widen(a: str, b: str) -> str:
    """The least upper bound of two file types."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    for chain in CHAINS:
        if a in chain and b in chain:
            return chain[max(chain.index(a), chain.index(b))]
    if {a, b} <= {"int8", "int16", "int32", "int64", "float", "double"}:
        return "double"
    return "string"


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for pdf in batches:
        for k, path in zip(pdf["seq"], pdf["path"]):
            fs, p = pafs.FileSystem.from_uri(path)
            schema = pq.read_schema(p, filesystem=fs)
            yield pd.DataFrame({"seq": k, "path": path, "pos": range(len(schema.names)), "name": schema.names, "type": [str(t).replace("large_", "").replace("[ns", "[us").replace("[ms", "[us") for t in schema.types]})


def read_drifting_parquet(spark: SparkSession, paths: list[str], aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One table from files of differing schemas, and the ordered log ``(seq, path, change, name, old, new)``.

    Footers are read by the executors, one row a column, and written down; types fold through the lattice to one row a
    column, and each file is compared with the one before it by a join on their numbers. Files of one schema are read by
    one scan, cast to the union schema and united by name. ``aliases`` maps new names to the old ones they replace; these
    show as ``renamed``. Columns that a file lacks are null. A clash of types that no chain holds becomes string. No
    path: no table, an error. The driver holds the caller's list of paths and the number of each file's schema.
    """
    if not paths:
        raise ValueError("no files")
    aliases = aliases or {}
    listing = shipped(spark).createDataFrame(list(enumerate(paths)), "seq bigint, path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism))
    seen = listing.mapInPandas(_footers, "seq bigint, path string, pos int, name string, type string")
    own = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), F.col("name")), F.col("name")) if aliases else F.col("name")
    fields = F.transform(F.sort_array(F.collect_list(F.struct("pos", own.alias("c"), "name", "type"))), lambda x: F.struct(x["c"].alias("c"), x["name"].alias("name"), x["type"].alias("type")))
    files = materialise(seen.groupBy("seq", "path").agg(fields.alias("fields")), "footers")

    columns = files.select("seq", F.posexplode("fields").alias("pos", "f")).groupBy("f.c").agg(F.collect_set("f.type").alias("types"), F.min(F.struct("seq", "pos")).alias("first"))
    union = {r["c"]: functools.reduce(widen, sorted(r["types"])) for r in sorted(columns.collect(), key=lambda r: tuple(r["first"]))}  # a row a column

    earlier = files.select((F.col("seq") + 1).alias("seq"), F.col("fields").alias("before"))
    pair = lambda x, y, both: F.flatten(F.transform(x, lambda p: both(p, F.filter(y, lambda q: q["c"] == p["c"]))))
    change = lambda kind, c, old, new: F.struct(F.lit(kind).alias("change"), c.alias("name"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    none = F.lit(None).cast("string")

    def against(n: Column, b: Column) -> Column:
        was = F.get(b, F.lit(0))
        added = F.when(F.size(b) == 0, change("added", n["c"], none, n["type"]))
        return F.array(added, F.when(was["name"] != n["name"], change("renamed", n["c"], was["name"], n["name"])), F.when(was["type"] != n["type"], change("retyped", n["c"], was["type"], n["type"])))

    gone = pair(F.col("before"), F.col("fields"), lambda b, n: F.array(F.when(F.size(n) == 0, change("removed", b["c"], b["type"], none))))
    every = F.array_compact(F.concat(pair(F.col("fields"), F.col("before"), against), gone))
    log = files.join(earlier, "seq").where(~F.col("fields").eqNullSafe(F.col("before"))).select("seq", "path", F.explode(every).alias("x")).select("seq", "path", "x.*")

    by_schema: dict[int, list[str]] = {}
    shapes = {}
    for r in files.select(F.xxhash64("fields").alias("h"), "fields").distinct().collect():  # a row a schema
        shapes[r["h"]] = {f["c"]: f["name"] for f in r["fields"]}
    for r in files.select("seq", F.xxhash64("fields").alias("h")).collect():
        by_schema.setdefault(r["h"], []).append(paths[r["seq"]])
    parts = []
    for h, named in by_schema.items():
        df, here = spark.read.parquet(*named), shapes[h]
        parts.append(df.select(*((F.col(f"`{here[c]}`") if c in here else F.lit(None)).cast(SPARK_OF.get(t, "string") if t != "null" else "string").alias(c) for c, t in union.items())))
    return functools.reduce(DataFrame.unionByName, parts), log.orderBy("seq", "change", "name")
