"""Comparisons and summaries of groups: thresholds, quantiles, tables, funnels, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ranks


def exceedances(df: DataFrame, keys: list[str], what: str, value: str, limits: dict[str, dict[str, float]]) -> DataFrame:
    """Days above each limit: limits {standard: {what: limit}} become a literal table joined on what."""
    spark = df.sparkSession
    rows = [(s, w, float(x)) for s, ws in sorted(limits.items()) for w, x in sorted(ws.items())]
    table = spark.createDataFrame(rows, f"standard string, {what} string, threshold double")
    joined = df.filter(F.col(value).isNotNull()).join(F.broadcast(table), what)  # a literal of a few rows
    out = joined.groupBy(*keys, what, "standard", "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) > F.col("threshold")).alias("above")
    )
    return out.withColumn("above_pct", 100.0 * F.col("above") / F.col("n"))


def summary_stats(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and median of each column, in long form."""
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values])))
    by = [*keys, "measure"]
    stats = long.groupBy(*by).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    return ranks.same_keys(stats, ranks.quantiles(long, by, "x", {"median": 0.5}), by)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles; null values are skipped."""
    return ranks.quantiles(df, keys, value, shares)


def common_dates(df: DataFrame, date: str, key: str, members: list, value: str) -> DataFrame:
    """One column per member, only dates on which all members have a value."""
    wide = df.filter(F.col(key).isin(members)).groupBy(date).pivot(key, members).agg(F.avg(value))
    return wide.dropna("any", subset=[str(m) for m in members])


def pivot_means(df: DataFrame, row: Column, row_name: str, column: Column, values: list, value: str, prefix: str) -> DataFrame:
    """A matrix of means with fixed columns."""
    wide = df.withColumn(row_name, row).withColumn("_c", column).groupBy(row_name).pivot("_c", values).agg(F.avg(value))
    return wide.select(row_name, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Counts in equal bins over [low, high], the right edge in the last bin; other values are left out."""
    inside = df.filter(F.col(value).between(low, high))
    bin_ = F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    return inside.groupBy(*(keys or []), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of pairs with fixed columns; absent pairs are 0."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0).cast("long")).alias(f"n_{v}") for v in values])


def funnel(df: DataFrame, steps: list[tuple[str, Column]], distinct: str) -> DataFrame:
    """Rows and distinct values left after each of successive filters, in one scan."""
    seen, parts = F.lit(True), []
    for n, (name, condition) in enumerate(steps):
        seen = seen & F.coalesce(condition, F.lit(False))
        parts.append(F.struct(F.lit(n).alias("step"), F.lit(name).alias("name"), seen.alias("kept")))
    long = df.select(F.col(distinct).alias("_d"), F.inline(F.array(*parts)))
    return long.groupBy("step", "name").agg(F.count_if("kept").alias("n_rows"), F.countDistinct(F.when(F.col("kept"), F.col("_d"))).alias("n_distinct"))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls of every column, in one pass: (column_name, n_rows, n_null)."""
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(df.columns)]
    return one.select("n_rows", F.inline(F.array(*parts))).select("column_name", "n_rows", "n_null")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and their share by value."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*columns, "n", (F.col("n") / df.agg(F.count(F.lit(1))).scalar()).alias("share"))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows; order must end with a unique key."""
    return df.orderBy(*order).limit(k)


def first_k_per_group(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of every group by a unique order of ascending columns.

    Only k rows of a group survive the map side: ranks within salted parts first, then among
    the survivors, so a hot group is never ranked in one task.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(64))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return few.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def best_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The row with the smallest order in each group; ties are broken by the later columns of order."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*keep), key).alias("_best")).select(*keys, "_best.*")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by order; combined before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("duplicates"), F.count(F.lit(1)).alias("keys"))


def reconcile(computed: DataFrame, published: DataFrame, keys: list[str], left: str, right: str, tolerance: float) -> DataFrame:
    """Computed against published values: difference and whether it is within the tolerance."""
    both = computed.join(published, keys)
    gap = F.abs(F.col(left) - F.col(right))
    return both.select(*keys, left, right, gap.alias("difference"), (gap <= tolerance).alias("agrees"))
