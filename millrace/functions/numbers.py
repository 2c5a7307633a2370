"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Season of each month, December first.
SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring"}
SEASONS |= {6: "summer", 7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def invalid_reading(time: Column, value: Column) -> Column:
    """No time, no finite value, or a negative one."""
    return time.isNull() | value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))) | (value < 0)


def lookup(key: Column, mapping: dict) -> Column:
    """mapping[key] as a literal map; null where the key is missing."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)


def season(date: Column) -> Column:
    """The season of a date's month."""
    return lookup(F.month(date), SEASONS)


def not_below_zero(x: Column) -> Column:
    """max(0, x) that keeps null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))


def cyclic_calendar(date: Column) -> dict[str, Column]:
    """Sine and cosine of the day of the year (365.25 days) and of the weekday (Monday 0)."""
    year = F.lit(2 * math.pi) * F.dayofyear(date) / F.lit(365.25)
    week = F.lit(2 * math.pi) * F.weekday(date) / F.lit(7.0)
    return {"sin_doy": F.sin(year), "cos_doy": F.cos(year), "sin_week": F.sin(week), "cos_week": F.cos(week)}


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def crop_bounds(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whole pixel bounds (left, top, right, bottom) of a box inside its image."""
    zero = F.lit(0)
    return F.struct(
        F.greatest(zero, x.cast("int")).alias("crop_left"),
        F.greatest(zero, y.cast("int")).alias("crop_top"),
        F.least(width, (x + w + F.lit(0.999)).cast("int")).alias("crop_right"),
        F.least(height, (y + h + F.lit(0.999)).cast("int")).alias("crop_bottom"),
    )


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_hex(text: Column) -> Column:
    """A 64-bit hash from up to 16 hex digits; null for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("long"))
