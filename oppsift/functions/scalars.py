"""Lenient casts, numbers, dates and keys as column expressions. Bad values become null and never stop a job."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counters are held within this.
COUNTER_CAP = 10**15


def counter(value: Column) -> Column:
    """A whole number from "1200", "1,234", "1.2K", "3M" or "4b"; null from anything else, negative strings too.

    value: a string column (numbers cast to string). Fractions are cut off, results held within COUNTER_CAP.
    """
    text = F.regexp_replace(F.trim(value), ",", "")
    shape = r"^(\d+(?:\.\d+)?)\s*([kKmMbB])?$"
    number = F.regexp_extract(text, shape, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, shape, 2))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    # least and greatest pass over nulls, so each stands behind a test
    return F.when(number.isNotNull(), F.least(number * factor, F.lit(float(COUNTER_CAP)))).cast("bigint")


def counter_of_number(value: Column) -> Column:
    """A whole number from a number: cut off, held within COUNTER_CAP, null if not finite."""
    number = value.try_cast("double")
    held = F.greatest(F.least(number, F.lit(float(COUNTER_CAP))), F.lit(-float(COUNTER_CAP)))
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), held).cast("bigint")


def counter_of_variant(value: Column) -> Column:
    """Of a variant field: numbers, truth values and strings as above; null from lists and objects."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", counter(F.try_variant_get(value, "$", "string")))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .otherwise(counter_of_number(F.try_variant_get(value, "$", "double")))
    )


def text_of_variant(value: Column) -> Column:
    """A string field as it is, a number as text; null from truth values, lists, objects and nulls."""
    kind = F.schema_of_variant(value)
    return F.when(kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "string"))


def squash(value: Column, saturate_at: float) -> Column:
    """0 to 1 on a logarithmic scale, 1 from ``saturate_at`` on."""
    return F.when(value <= 0, 0.0).when(value > 0, F.least(F.lit(1.0), F.log1p(value.cast("double")) / F.lit(math.log1p(saturate_at))))


def mail_date(text: Column) -> Column:
    """A timestamp from a date like "Wed Sep 02 19:33:47 +0000 2026" or "Wed, 02 Sep 2026 19:33:47 +0000"."""
    post = F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))
    mail = F.try_to_timestamp(F.regexp_replace(text, r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(post, mail)


def epoch_date(seconds: Column) -> Column:
    number = seconds.try_cast("double")
    return F.when(F.abs(number) < 1e11, F.timestamp_seconds(number))


def parts_date(parts: Column) -> Column:
    """From an array (year, month, day, hour, minute, second, ...)."""
    p = [F.get(parts, k).cast("int") for k in range(6)]
    return F.when(F.size(parts) >= 6, F.try_make_timestamp(*p[:5], p[5].cast("decimal(8,6)")))


def iso_date(text: Column) -> Column:
    return text.try_cast("timestamp")


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def hours_since(ts: Column, as_of: Column) -> Column:
    """Hours from ts to as_of, 0 at least; 999 without a time."""
    hours = hours_between(ts, as_of)
    return F.when(hours.isNull(), 999.0).otherwise(F.greatest(F.lit(0.0), hours))


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values))


def content_hash(canonical_url: Column, normalised: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(canonical_url, F.lit("")), F.lit("|"), normalised), 256)


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals, halves up, by its binary value: Spark's own rounds the decimal digits that a double is written with,
    and so lifts a double just below a half, such as 0.01275, to the next number."""
    scale = 10.0**digits
    scaled = x * scale
    low = F.floor(scaled).cast("double")
    return (low + F.when(scaled - low >= 0.5, 1.0).otherwise(0.0)) / scale


def shown(x: Column, digits: int) -> Column:
    """x to so many decimals as text, by its exact binary value: what is printed of 0.345 is 0.34 or 0.35 as the double lies."""
    scale, split = 10.0**digits, 134217729.0
    scaled = x * scale
    low = F.floor(scaled)
    high = x * split - (x * split - x)  # the upper half of the bits, so that both products below are exact
    error = (high * scale - scaled) + (x - high) * scale
    half = scaled - low == 0.5
    up = (scaled - low > 0.5) | half & ((error > 0) | (error == 0) & (low % 2 == 1))
    return F.format_string(f"%.{digits}f", (low + F.when(up, 1).otherwise(0)) / scale)
