"""Exact ranks and quantiles of groups of any size: values are counted, cut into ranges and only ranked within one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of about equal size that a column's values are cut into, by approximate quantiles.
RANGES = 32
#: Rows of a range beyond which it is cut again, into at most so many equally wide parts.
RANGE_ROWS, MOST_PARTS = 500_000, 4_096


class Ranges:
    """Cuts of columns into ranges, sized from the rows; RANGES numbers a column reach the driver."""

    def __init__(self, df: DataFrame, columns: list[str]) -> None:
        shares = [i / RANGES for i in range(1, RANGES)]
        x = [F.col(f"`{c}`").cast("double") for c in columns]
        wanted = [F.percentile_approx(v, shares, 10 * RANGES).alias(f"q{i}") for i, v in enumerate(x)]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *wanted, *[F.count(v).alias(f"n{i}") for i, v in enumerate(x)]).first()
        self.cuts = {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(columns)}
        self.complete = {c: row[f"n{i}"] == row["rows"] for i, c in enumerate(columns)}
        self.parts = min(MOST_PARTS, max(1, row["rows"] // RANGES // RANGE_ROWS))

    def of(self, column: str) -> Callable[[Column], Column]:
        """The part of a value of a column: it never decreases with the value."""
        return lambda x: self._part(self.cuts[column], x)

    def of_any(self, number: str, columns: list[str]) -> Callable[[Column], Column]:
        """The same for rows of several columns; column `number` tells which."""

        def part(x: Column) -> Column:
            out = F.lit(0)
            for i, c in enumerate(columns):
                out = F.when(F.col(number) == i, self._part(self.cuts[c], x)).otherwise(out)
            return out

        return part

    def _part(self, cuts: list[float], x: Column) -> Column:
        ends = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
        at = F.size(F.filter(ends, lambda c: c < x))
        if self.parts == 1 or len(cuts) < 2:
            return at
        low, high = F.get(ends, at - 1), F.get(ends, at)
        within = F.when((low < high) & x.isNotNull(), F.width_bucket(x, low, high, F.lit(self.parts)))
        return at * F.lit(self.parts + 2) + F.coalesce(within, F.lit(0)).cast("int")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, null matching null."""
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    match = F.lit(True)
    for c in keys:
        match = match & F.col(f"`{c}`").eqNullSafe(F.col(f"`_right_{c}`"))
    return left.join(named, match, how).drop(*[f"_right_{c}" for c in keys])


def value_ranks(df: DataFrame, keys: list[str], value: str, part: Callable[[Column], Column], weight: str | None = None) -> DataFrame:
    """(keys, value, _n, _before, _total): rows with each distinct value, with smaller ones, and all, within keys.

    Values are counted first, so ties cost nothing. part, which never decreases with
    the value, cuts the ranking: counts of earlier parts are summed up and only the values of
    one part meet in a window, so a large group is ranked by many tasks. Null values have no rank.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("_n")).withColumn("_part", part(F.col(value)))
    group = Window.partitionBy(*keys)
    parts = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_all"))
    earlier = F.sum("_all").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*keys, "_part", F.coalesce(earlier, F.lit(0)).alias("_earlier"), F.sum("_all").over(group).alias("_total"))
    upto = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = same_keys(counts.withColumn("_below", F.coalesce(F.sum("_n").over(upto), F.lit(0))), parts, [*keys, "_part"])
    return within.select(*keys, value, "_n", (F.col("_earlier") + F.col("_below")).alias("_before"), "_total")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str, part: Callable[[Column], Column], weight: str | None = None) -> DataFrame:
    """(keys, value, name): the average-tie rank of each distinct value within keys."""
    ranks = value_ranks(df, keys, value, part, weight)
    return ranks.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, names): linearly interpolated quantiles; null values are skipped, a group without values has null."""
    rows = df.select(*keys, F.col(f"`{value}`").cast("double").alias("_x"))
    ranks = value_ranks(rows, keys, "_x", Ranges(rows, ["_x"]).of("_x"))
    ends = []
    for i, q in enumerate(shares.values()):
        at = F.lit(float(q)) * (F.col("_total") - 1)
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            held = (F.col("_before") <= place) & (place < F.col("_before") + F.col("_n"))
            ends.append(F.max(F.when(held, F.col("_x"))).alias(f"_{side}{i}"))
    found = ranks.groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    out = []
    for i, (name, q) in enumerate(shares.items()):
        at = F.lit(float(q)) * (F.col("_total") - 1)
        out.append((F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (at - F.floor(at))).alias(name))
    found = found.select(*keys, *out)
    return same_keys(df.select(*keys).distinct(), found, keys, "left") if keys else found
