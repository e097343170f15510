"""Small numeric and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of the wall clock, whatever the session time zone."""
    seconds = F.extract(F.lit("SECOND"), ts)  # decimal(8, 6)
    return (
        F.unix_date(F.to_date(ts)).cast("long") * F.lit(86_400_000_000)
        + F.hour(ts).cast("long") * F.lit(3_600_000_000)
        + F.minute(ts).cast("long") * F.lit(60_000_000)
        + (seconds * F.lit(1_000_000)).cast("long")
    )


def floor_div(x: Column, width: int) -> Column:
    """Whole-number division rounding down, also below zero."""
    return F.call_function("div", x - F.pmod(x, F.lit(width)), F.lit(width))


def round_binary(x: Column, scale: int = 2) -> Column:
    """Round the exact binary value, ties to even, for moderate ``x`` >= 0.

    ``F.round`` works on the shortest decimal spelling and makes 0.68 of 0.675, whose binary
    value lies below the tie.  The error of ``x * 10**scale`` is recovered exactly by splitting
    ``x`` into two halves, and decides when the product itself sits on a tie.
    """
    factor = F.lit(float(10**scale))
    product = x * factor
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    error = (high * factor - product) + (x - high) * factor
    below = F.floor(product).cast("double")
    half = product - below
    odd = F.pmod(below, F.lit(2.0)) == 1.0
    up = (half > 0.5) | ((half == 0.5) & ((error > 0.0) | ((error == 0.0) & odd)))
    return (below + F.when(up, 1.0).otherwise(0.0)) / factor


_STRICT_JSON = {"allowSingleQuotes": "false"}


def json_object(text: Column) -> Column:
    """A JSON object as map<string,string>; null for any other or malformed text.

    Parsed as the only element of an array, so that text after the object counts as malformed.
    """
    parsed = F.from_json(_as_element(text), "array<map<string,string>>", _STRICT_JSON)
    return F.when(F.size(parsed) == 1, parsed[0])


def json_strings(text: Column) -> Column:
    """A JSON list as array<string>, an empty array for other JSON; null for malformed text."""
    parsed = F.from_json(_as_element(text), "array<array<string>>", _STRICT_JSON)
    items = F.when(F.size(parsed) == 1, parsed[0])
    valid = F.try_parse_json(_as_element(text)).isNotNull()
    return F.when(valid, F.coalesce(items, F.array().cast("array<string>")))


def _as_element(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]"))
