"""Series of days: dense calendars, lags, rolling statistics, islands, baselines.

All windows are partitioned by the series; a series of days is short (365 rows a year), so
its window fits a task whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """All days between the first and the last of each series; days without a row are null elsewhere."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = ends.filter("_a IS NOT NULL").select(*keys, F.explode(F.sequence("_a", "_b")).alias(date))
    return days.join(df, [*keys, date], "left")


def lags(df: DataFrame, keys: list[str], date: str, value: str, ks: list[int]) -> DataFrame:
    """lagK columns: the value k rows earlier, on a dense calendar k days earlier."""
    order = Window.partitionBy(*keys).orderBy(date)
    return df.withColumns({f"lag{k}": F.lag(value, k).over(order) for k in ks})


def rolling(df: DataFrame, keys: list[str], date: str, value: str, means: dict[int, int], stds: dict[int, int]) -> DataFrame:
    """Past-only rolling means and sample deviations: {days: least number of values}; the day itself is excluded."""
    order = Window.partitionBy(*keys).orderBy(date)
    out = {}
    for w, least in means.items():
        past = order.rowsBetween(-w, -1)
        out[f"rolling_mean{w}"] = F.when(F.count(value).over(past) >= least, F.avg(value).over(past))
    for w, least in stds.items():
        past = order.rowsBetween(-w, -1)
        out[f"rolling_std{w}"] = F.when(F.count(value).over(past) >= least, F.stddev_samp(value).over(past))
    return df.withColumns(out)


def islands(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """island: the same number for days that follow each other without a gap (dates must be unique)."""
    order = Window.partitionBy(*keys).orderBy(date)
    return df.withColumn("island", F.date_sub(date, F.row_number().over(order)))


def island_features(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Lags, differences and deviations that never cross a gap, for the day after each run of days.

    Columns: value_lag1, delta_lag1..3, deviation_mean3 and 7 (full windows only),
    mean_change7, delta_target. Null where the island is too young.
    """
    marked = islands(df, keys, date)
    order = Window.partitionBy(*keys, "island").orderBy(date)
    back = {k: F.lag(value, k).over(order) for k in range(1, 8)}
    out = {"value_lag1": back[1], "delta_target": F.col(value) - back[1], "mean_change7": (back[1] - back[7]) / 6}
    for k in (1, 2, 3):
        out[f"delta_lag{k}"] = back[k] - back[k + 1]
    for w in (3, 7):
        past = order.rowsBetween(-w, -1)
        out[f"deviation_mean{w}"] = back[1] - F.when(F.count(value).over(past) == w, F.avg(value).over(past))
    return marked.withColumns(out)


def continuity_diff(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """delta: change to the previous row, only where that is the day before."""
    order = Window.partitionBy(*keys).orderBy(date)
    return df.withColumn("delta", F.when(F.datediff(F.col(date), F.lag(date).over(order)) == 1, F.col(value) - F.lag(value).over(order)))


def chronological_split(date: Column, validation_from: str, test_from: str) -> Column:
    """train, validation or test by date."""
    return (
        F.when(date >= F.lit(test_from).cast("date"), "test").when(date >= F.lit(validation_from).cast("date"), "validation").when(date.isNotNull(), "train")
    )


def baselines(df: DataFrame, keys: list[str], date: str, value: str, train: Column | None = None) -> DataFrame:
    """Forecasts that need no fit: persistence, the value a week ago, drift, and the mean of the rows where train holds."""
    order = Window.partitionBy(*keys).orderBy(date)
    one, two, seven = (F.lag(value, k).over(order) for k in (1, 2, 7))
    out = {"persistence": one, "seasonal_naive7": seven, "drift": 2 * one - two}
    if train is not None:
        out["train_mean"] = F.avg(F.when(train, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumns(out)
