"""Number expressions that keep one rounding rule each, and null-safe cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities become null, so that aggregates skip them."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10.0**digits
    out = F.floor(x * F.lit(scale) + F.lit(0.5))
    return out / F.lit(scale) if digits else out


def two_decimals(x: Column) -> Column:
    """A number as text with two decimals: the nearest to its exact binary value, ties to even, as printf writes it. Java's formatter
    rounds the shortest decimal that reads back as the number, so 0.295, whose binary value is below, came out as 0.30.

    100 x is the double `p` and an exact remainder (Dekker's product); from 1e13 on a cent is near the last digit of a double."""

    def text(v: Column) -> Column:
        size = F.abs(v)
        p, split = size * 100.0, size * 134217729.0
        high = split - (split - size)
        rest = (high * 100.0 - p) + (size - high) * 100.0
        whole = F.floor(p)
        over = (p - whole - 0.5) + rest
        cents = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
        near = F.concat(F.when(v < 0, "-").otherwise(""), F.regexp_replace(F.format_string("%03d", cents), "(..)$", ".$1"))
        return F.when(size < 1e13, near).otherwise(F.format_string("%.2f", v))

    return F.transform(F.array(x.cast("double")), text)[0]


def as_float32(x: Column) -> Column:
    """The nearest single-precision number, as a double: feature values are stored so before they serve as thresholds."""
    return x.cast("float").cast("double")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def parse_number(text: Column) -> Column:
    """A form field as a number: trimmed, comma or point; blanks, text and infinities are null."""
    return clean(F.translate(F.trim(text), ",", ".").try_cast("double"))


def parse_tick(text: Column) -> Column:
    """The first number in an axis label read by OCR, null without one, as a struct (value, fragment): a bare
    fraction such as ".5" is a fragment of the label above."""
    t = F.translate(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^[><≥≤=~ ]+", ""), ",", ".")
    body = F.regexp_extract(t, r"-?\d*\.?\d+", 0)
    fragment = body.startswith(".")
    value = F.when(body != "", F.when(fragment, F.concat(F.lit("0"), body)).otherwise(body).cast("double"))
    return F.struct(value.alias("value"), (fragment & value.isNotNull()).alias("fragment"))
