"""Identifiers: UUIDs whose letter case and hyphens don't matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_id(col: Column | str) -> Column:
    """Lower-case hexadecimal digits without hyphens, the form to group and join by; null for null or blank.

    Text that isn't a UUID is an identifier too; it is lower-cased and loses its hyphens likewise.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.trim(F.translate(c, "-\u0000", ""))), F.lit(""))


def spelled(bare: Column | str) -> Column:
    """The spelling of results: hyphens after 8, 12, 16 and 20 digits if there are 32 of them."""
    c = F.col(bare) if isinstance(bare, str) else bare
    cut = [F.substring(c, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(c) == 32, F.concat_ws("-", *cut)).otherwise(c)


def json_object(value: Column | str) -> Column:
    """The value as variant if it is one valid JSON object, else null.

    Parsing it inside brackets lets the parser see what follows the object, so trailing text makes it invalid.
    """
    c = F.col(value) if isinstance(value, str) else value
    open_ = F.ltrim(c, F.lit(" \t\n\r")).startswith("{")
    whole = F.when(open_, F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))))
    # a lambda's variable is computed once, however often it is used
    alone = F.transform(F.array(whole), lambda w: F.when(F.try_variant_get(w, "$[1]", "variant").isNull(), F.try_variant_get(w, "$[0]", "variant")))
    return F.get(alone, F.lit(0))


def message_id(value: Column | str) -> Column:
    """The bare identifier of a message: the top-level event_id of a value that is a valid JSON object."""
    c = F.col(value) if isinstance(value, str) else value
    # the pattern spares messages without the name the parse
    return bare_id(F.when(c.contains('"event_id"'), F.try_variant_get(json_object(c), "$.event_id", "string")))
