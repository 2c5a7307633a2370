"""Irregular readings onto a regular hourly grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.times import finite, hour_epoch, readable_time

#: Hours in one block of a series' grid: the unit of work, so a long series is many tasks' work.
BLOCK_HOURS = 512


def operating_periods(stations: DataFrame) -> DataFrame:
    """Operating periods as whole hours (station_id, parameter, from_hour, to_hour), overlaps merged.

    Rows with a null station, parameter or end, and empty periods, are no periods. The
    table has one row per post, parameter and period, so a post's rows fit one task.
    """
    hours = stations.select(
        "station_id",
        "parameter",
        hour_epoch(F.col("active_from").cast("timestamp")).alias("f"),
        hour_epoch(F.col("active_to").cast("timestamp")).alias("t"),
    ).filter("station_id IS NOT NULL AND parameter IS NOT NULL AND f < t")
    order = Window.partitionBy("station_id", "parameter").orderBy("f", "t")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = hours.withColumn("new", F.coalesce((F.col("f") > F.max("t").over(before)).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("station_id", "parameter", "island").agg(F.min("f").alias("from_hour"), F.max("t").alias("to_hour")).drop("island")


def hourly_means(readings: DataFrame, value: str = "value_ugm3") -> DataFrame:
    """Bucket aggregation: (station_id, parameter, h, mean, n) per hour with a usable reading.

    Usable: readable time, finite value of at least 0. A reading delivered again counts once.
    """
    used = readings.select("reading_id", "station_id", "parameter", readable_time("datetime_utc").alias("t"), finite(value).alias("v"))
    used = used.filter("t IS NOT NULL AND v >= 0 AND station_id IS NOT NULL AND parameter IS NOT NULL")
    used = used.withColumn("h", hour_epoch(F.col("t")))
    once = used.groupBy("station_id", "parameter", "h", "reading_id").agg(F.min("v").alias("v"))
    return once.groupBy("station_id", "parameter", "h").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


def grid_blocks(stations: DataFrame) -> DataFrame:
    """The grid in blocks: (station_id, parameter, block, lo, hi), hours lo <= h < hi of one period."""
    periods = operating_periods(stations)
    size = F.lit(BLOCK_HOURS)
    blocks = periods.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("from_hour") / size), F.floor((F.col("to_hour") - 1) / size)))
    )
    return blocks.select(
        "station_id",
        "parameter",
        "block",
        F.greatest("from_hour", F.col("block") * size).alias("lo"),
        F.least("to_hour", (F.col("block") + 1) * size).alias("hi"),
        "from_hour",
    )


def regular_grid(readings: DataFrame, stations: DataFrame, max_gap: int = 0, value: str = "value_ugm3") -> DataFrame:
    """One row per hour of each operating period, filled or marked.

    The time sequence of every period is cut into blocks of BLOCK_HOURS; the hourly means are
    left-joined block by block (one list of at most BLOCK_HOURS means each), so the long grid
    itself is never shuffled. An empty hour takes the last mean of its own period if that is
    at most max_gap hours old (status carried), else stays null (status missing). To carry
    across blocks, means of the last max_gap hours of a block go to the next one too.

    A post without readings has all hours missing; readings outside the periods or of
    unknown posts have no rows; columns beside the named ones are ignored. Empty stations:
    no rows. max_gap 0 carries nothing; it must be below BLOCK_HOURS.
    Returns (station_id, parameter, hour_epoch, value, n_readings, status).
    """
    if not 0 <= max_gap < BLOCK_HOURS:
        raise ValueError("max_gap must be from 0 to BLOCK_HOURS - 1")
    size = F.lit(BLOCK_HOURS)
    means = hourly_means(readings, value).withColumn("block", F.floor(F.col("h") / size))
    if max_gap:
        late = (F.col("h") % size) >= BLOCK_HOURS - max_gap
        means = means.withColumn("block", F.explode(F.when(late, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))))
    lists = means.groupBy("station_id", "parameter", "block").agg(F.collect_list(F.struct("h", "mean", "n")).alias("seen"))
    joined = grid_blocks(stations).join(lists, ["station_id", "parameter", "block"], "left")
    joined = joined.withColumn("seen", F.expr("filter(coalesce(seen, array()), s -> s.h < hi AND s.h >= from_hour)"))
    rows = joined.select(
        "station_id",
        "parameter",
        "block",
        "lo",
        F.expr(
            "inline(concat(transform(array_except(sequence(lo, hi - 1), transform(seen, s -> s.h)),"
            " h -> struct(h AS hour_epoch, CAST(NULL AS double) AS mean, 0L AS n_readings)),"
            " transform(seen, s -> struct(s.h AS hour_epoch, s.mean AS mean, s.n AS n_readings))))"
        ),
    )
    here = F.col("hour_epoch") >= F.col("lo")
    if not max_gap:
        status = F.when(F.col("n_readings") > 0, "observed").otherwise("missing")
        return rows.filter(here).select(
            "station_id", "parameter", "hour_epoch", F.col("mean").alias("value"), "n_readings", status.alias("status")
        )
    past = Window.partitionBy("station_id", "parameter", "block", "lo").orderBy("hour_epoch").rangeBetween(-max_gap, 0)
    filled = rows.withColumn("value", F.last("mean", ignorenulls=True).over(past)).filter(here)
    status = F.when(F.col("n_readings") > 0, "observed").when(F.col("value").isNotNull(), "carried").otherwise("missing")
    return filled.select("station_id", "parameter", "hour_epoch", "value", "n_readings", status.alias("status"))


def empty_hours(readings: DataFrame, stations: DataFrame, value: str = "value_ugm3") -> DataFrame:
    """Grid hours without a usable reading: (station_id, parameter, hour_epoch)."""
    grid = regular_grid(readings, stations, 0, value)
    return grid.filter("status = 'missing'").select("station_id", "parameter", "hour_epoch")


def hours_per_day(readings: DataFrame, stations: DataFrame, offset_hours: int = 5, value: str = "value_ugm3") -> DataFrame:
    """n_hours of every local day of the operating periods: (station_id, parameter, local_date, n_hours)."""
    grid = regular_grid(readings, stations, 0, value)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col("hour_epoch") + offset_hours) / 24).cast("int"))
    days = grid.groupBy("station_id", "parameter", day.alias("local_date"))
    return days.agg(F.count_if(F.col("n_readings") > 0).alias("n_hours"))
