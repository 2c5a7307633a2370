"""Text expressions: polish of report text, relative paths, forecast origins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Links, code and addresses, which polish leaves alone.
PROTECTED = r"\]\([^\n)]*\)|`[^`]+`|https?://\S+"


def polish(x: Column) -> Column:
    """Text polished outside of links, code and addresses (PROTECTED), which stay as they are."""
    kept = F.regexp_extract_all(x, F.lit(f"({PROTECTED})"), F.lit(1))
    parts = F.zip_with(F.split(x, PROTECTED, -1), kept, lambda a, b: F.concat(_polish(a), F.coalesce(b, F.lit(""))))
    return F.trim(F.array_join(parts, ""))


def has_prefix(x: Column, prefix: str) -> Column:
    """Whether a text begins with prefix; false for null. A plain prefix reaches the scan as a filter."""
    return F.coalesce(x.startswith(prefix), F.lit(False))


def _polish(x: Column) -> Column:
    """A blank between a letter and a following number of two or more digits, and single blanks elsewhere.

    Names with an underscore or a dot (file names, codes) are left as they are.
    """
    spaced = F.regexp_replace(x, r"(?<![\p{L}0-9_.])(\p{L}{2,})([0-9]{2,})(?![\p{L}0-9_.])", "$1 $2")
    return F.regexp_replace(spaced, r"[ \t]+", " ")


def is_relative_path(x: Column) -> Column:
    """A path inside its folder: no scheme, no leading slash, no step upwards."""
    return ~x.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)") & ~x.rlike(r"(^|/)[.][.](/|$)")


def unquoted_path(url: Column) -> Column:
    """The path of a URL with its escapes resolved; null for text that is no URL."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("PATH")))


def origin_label(date: Column, offset: str = "+05:00") -> Column:
    """Midnight of a local date as ISO text."""
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T00:00:00" + offset))
