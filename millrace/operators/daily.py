"""From station-hour readings to completeness-gated daily facts and their summaries.

Every grouping combines before the shuffle. Null keys form groups of their own unless said
otherwise; NaN must have been made null at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import days_in_year, invalid_reading, is_close, season
from millrace.operators import ranks

MIN_HOURS = 18


def local_date(time: Column, zone: str = "Asia/Atyrau") -> Column:
    return F.to_date(F.from_utc_timestamp(time, zone))


def gated_daily_means(df: DataFrame, keys: list[str], time: Column, value: str, day: Column | None = None, min_hours: int = MIN_HOURS) -> DataFrame:
    """Daily mean and distinct hours by keys; value only on days of at least min_hours.

    Returns keys, local_date, mean_value (always), n_hours, valid_day, value (null on other days).
    """
    rows = df.withColumn("local_date", local_date(time) if day is None else day).withColumn("_hour", F.date_trunc("hour", time))
    daily = rows.groupBy(*keys, "local_date").agg(F.avg(value).alias("mean_value"), F.countDistinct("_hour").alias("n_hours"))
    daily = daily.withColumn("valid_day", F.col("n_hours") >= min_hours)
    return daily.withColumn("value", F.when(F.col("valid_day"), F.col("mean_value")))


def yearly_coverage(daily: DataFrame, keys: list[str], date: str = "local_date", valid: str = "valid_day") -> DataFrame:
    """Days seen and valid by keys and year, and their share of the calendar year's days."""
    years = daily.withColumn("year", F.year(date)).groupBy(*keys, "year")
    out = years.agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col(valid)).alias("valid_days"), F.avg(F.col(valid).cast("int")).alias("valid_share"))
    return out.withColumn("coverage", F.col("valid_days") / days_in_year(F.col("year")))


def monthly_means(daily: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Monthly mean by keys over a gapless calendar of months; empty months are null."""
    months = daily.withColumn("month", F.trunc(date, "month").cast("date"))
    means = months.groupBy(*keys, "month").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    ends = means.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = ends.select(*keys, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    joined = grid.join(means, [*keys, "month"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def seasonal_summary(daily: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Count, mean and median of the values by keys, year and season."""
    rows = daily.withColumn("year", F.year(date)).withColumn("season", season(F.col(date)))
    by = [*keys, "year", "season"]
    means = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"))
    return ranks.same_keys(means, ranks.quantiles(rows, by, value, {"median_value": 0.5}), by)


def paired_day_quality(hourly: DataFrame, keys: list[str], fine: str, coarse: str, min_hours: int = MIN_HOURS) -> DataFrame:
    """Days whose shared hours suffice, and on how many the finer value exceeds the coarser (by a fifth).

    hourly: one row per key, local_date and hour with both values; rows lacking one are no pair.
    """
    pairs = hourly.filter(F.col(fine).isNotNull() & F.col(coarse).isNotNull())
    days = pairs.groupBy(*keys, "local_date").agg(F.count(F.lit(1)).alias("shared"), F.avg(fine).alias("fine"), F.avg(coarse).alias("coarse"))
    days = days.filter(F.col("shared") >= min_hours)
    above, far = F.col("fine") > F.col("coarse"), F.col("fine") > 1.2 * F.col("coarse")
    out = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("paired_days"), F.count_if(above).alias("above_days"), F.count_if(far).alias("far_above_days"))
    return out.withColumn("above_pct", 100.0 * F.col("above_days") / F.col("paired_days"))


def completeness_sensitivity(daily: DataFrame, key: str, members: list, date: str, value: str, hours: str, minima: list[int]) -> DataFrame:
    """Common days of all members, mean and median of each, once for every minimum of hours.

    The minima are a literal array exploded in the one scan; no pass for each.
    """
    rows = daily.filter(F.col(key).isin(members)).withColumn("min_hours", F.explode(F.array(*[F.lit(m) for m in minima])))
    rows = rows.filter(F.col(hours) >= F.col("min_hours")).filter(F.col(value).isNotNull())
    common = rows.groupBy("min_hours", date).agg(F.countDistinct(key).alias("k")).filter(F.col("k") == len(members)).drop("k")
    both = rows.join(common, ["min_hours", date])
    by = ["min_hours", key]
    means = both.groupBy(*by).agg(F.countDistinct(date).alias("common_days"), F.avg(value).alias("mean_value"))
    return ranks.same_keys(means, ranks.quantiles(both, by, value, {"median_value": 0.5}), by)


def cleaning_audit(
    df: DataFrame, by: str, key: list[str], time: Column, value: str, raw: str, factor: float | Column, first: str, last: str,
    selected: Column | None = None, station: str | None = None, local: Column | None = None,
) -> DataFrame:
    """Rows dropped by each cleaning step in order: not selected, invalid, unit mismatch, duplicate, outside the dates.

    A unit mismatch is raw * factor not close to value (a null factor is one). Duplicates are repeats of key among
    the rows left; of a key's times the first counts. Of the retained rows also the station-days
    (station: its column, the first of key by default; local: the date of a time in column _t, UTC by default), and how many of these have MIN_HOURS different times.
    """
    whole = df.withColumn("_selected", F.coalesce(selected, F.lit(False)) if selected is not None else F.lit(True))
    rows = whole.withColumn("_t", time)
    bad = invalid_reading(F.col("_t"), F.col(value))
    unit = ~F.coalesce(is_close(F.col(raw) * factor, F.col(value), 1e-6, 1e-3), F.lit(False))
    stage = F.when(~F.col("_selected"), 0).when(bad, 1).when(unit, 2).otherwise(3)
    inside = F.to_date("_t").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    rows = rows.withColumn("_stage", stage).withColumn("_inside", F.col("_stage").eqNullSafe(3) & inside)
    # equal keys meet in one row per key and group: no window over a hot group
    per_key = rows.groupBy(by, F.when(F.col("_stage") == 3, F.struct(*key)).alias("_key"), "_stage").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("_inside").cast("int")).alias("inside"), F.min("_t").alias("_t"), F.min(station or key[0]).alias("_station")
    )
    days = per_key.filter("_stage = 3 AND inside = 1").groupBy(by, "_station", (local if local is not None else F.to_date("_t")).alias("_day"))
    days = days.agg(F.countDistinct("_t").alias("_hours")).groupBy(by)
    days = days.agg(F.count(F.lit(1)).alias("station_days"), F.count_if(F.col("_hours") >= MIN_HOURS).alias("valid_station_days"))
    third = F.col("_stage") == 3
    counts = per_key.groupBy(by).agg(
        F.sum("n").alias("raw_rows"),
        F.coalesce(F.sum(F.when(F.col("_stage") > 0, F.col("n"))), F.lit(0).cast("long")).alias("selected_rows"),
        F.coalesce(F.sum(F.when(F.col("_stage") == 1, F.col("n"))), F.lit(0).cast("long")).alias("invalid_rows"),
        F.coalesce(F.sum(F.when(F.col("_stage") == 2, F.col("n"))), F.lit(0).cast("long")).alias("unit_rows"),
        F.coalesce(F.sum(F.when(third, F.col("n") - 1)), F.lit(0).cast("long")).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(third, F.col("inside"))), F.lit(0)).cast("long").alias("retained_rows"),
    )
    out = ranks.same_keys(counts, days, [by], "left")
    return out.fillna(0, ["station_days", "valid_station_days"])
