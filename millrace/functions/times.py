"""Reading times written in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format: ISO date, T or blank, time, and an offset (Z, +hh:mm or +hhmm).
ISO_WITH_OFFSET = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$"


def readable_time(column: str) -> Column:
    """The instant of an ISO text with offset, else null.

    A text without an offset names no instant and is unreadable, as are impossible dates,
    blanks and null. Outer blanks are ignored.
    """
    text = F.trim(F.col(column))
    return F.when(text.rlike(ISO_WITH_OFFSET), F.try_to_timestamp(F.regexp_replace(text, "([+-][0-9]{2})([0-9]{2})$", "$1:$2")))


def finite(column: str) -> Column:
    """The number, or null for NaN and infinities."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def hour_epoch(time: Column) -> Column:
    """Whole hours since 1970-01-01T00:00Z."""
    return F.floor(F.unix_seconds(time) / 3600).cast("long")
