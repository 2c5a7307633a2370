"""Queries of the general problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import grid, profile, spikes
from millrace.sources.tables import table

#: Hours that a reading is carried forward.
MAX_GAP = 6


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.found_rows(table(spark, folder, "air_hourly"), table(spark, folder, "air_pairs"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible_pairs(table(spark, folder, "air_pairs"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return grid.empty_hours(table(spark, folder, "air_hourly"), table(spark, folder, "station_metadata"))


def p4_regular_series(spark: SparkSession, folder: str) -> DataFrame:
    filled = grid.regular_grid(table(spark, folder, "air_hourly"), table(spark, folder, "station_metadata"), MAX_GAP)
    return filled.withColumn("value", F.round("value", 6))


def p4_hours_per_day(spark: SparkSession, folder: str) -> DataFrame:
    return grid.hours_per_day(table(spark, folder, "air_hourly"), table(spark, folder, "station_metadata"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return profile.changed_columns(table(spark, folder, "air_daily"))


def p5_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_profile(table(spark, folder, "air_daily"))


def p5_rare_masks(spark: SparkSession, folder: str) -> DataFrame:
    return profile.rare_masks(table(spark, folder, "air_daily"))


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The exact part of the profile: rows, rates of nulls and NaN, ranges, and distinct values of all but real columns."""
    rows = profile.column_profile(table(spark, folder, "air_daily"))
    real = F.col("column_name").isin("mean_ugm3", "value_ugm3")
    number = real | (F.col("column_name") == "n_hours")
    shown = [F.when(number, F.round(F.expr(f"try_cast({c} AS double)"), 6)).alias(f"{c[:3]}_number") for c in ("min_value", "max_value")]
    texts = [F.when(~number, F.col(c)).alias(f"{c[:3]}_text") for c in ("min_value", "max_value")]
    rates = [F.round(c, 9).alias(c) for c in ("null_rate", "nan_rate")]
    return rows.select("load_no", "column_name", "n_rows", *rates, F.when(~real, F.col("n_distinct")).alias("n_distinct"), *shown, *texts)


def p2_negative(spark: SparkSession, folder: str) -> DataFrame:
    """The part of p2_found that a bound decides: negative readings."""
    return spikes.implausible_readings(table(spark, folder, "air_hourly")).filter("kind = 'negative'").select("reading_id")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_negative, p2_pairs, p4_found, p4_regular_series, p4_hours_per_day, p5_found, p5_profile, p5_rates, p5_rare_masks)
}

_USED = """
used AS (
  SELECT station_id, parameter, reading_id, min(value_ugm3) AS v,
         CAST(floor(epoch(TRY_CAST(regexp_replace(trim(datetime_utc), '([+-][0-9]{2})([0-9]{2})$', '\\1:\\2') AS TIMESTAMPTZ)) / 3600) AS BIGINT) AS h
  FROM air_hourly
  WHERE regexp_matches(trim(datetime_utc), '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$')
    AND value_ugm3 >= 0 AND NOT isnan(value_ugm3) AND NOT isinf(value_ugm3)
  GROUP BY ALL),
means AS (SELECT station_id, parameter, h, avg(v) AS mean, count(*) AS n FROM used WHERE h IS NOT NULL GROUP BY ALL),
grid AS (
  SELECT DISTINCT station_id, parameter, unnest(generate_series(
      CAST(floor(epoch(active_from) / 3600) AS BIGINT), CAST(floor(epoch(active_to) / 3600) AS BIGINT) - 1)) AS hour_epoch
  FROM station_metadata WHERE active_from < active_to)
"""

_REAL, _ODD = ("mean_ugm3", "value_ugm3"), ("n_hours",)
_TEXTS = ("city", "station_id", "local_date", "parameter", "valid_day", "reference_station")


def _rates_sql(c: str) -> str:
    number = c in _REAL + _ODD
    nan = f"isnan({c})" if c in _REAL else "false"
    ends = {e: f"{e}({c}) FILTER (WHERE NOT {nan})" for e in ("min", "max")}
    numbers = [f"round(CAST({ends[e]} AS DOUBLE), 6)" if number else "CAST(NULL AS DOUBLE)" for e in ends]
    texts = ["CAST(NULL AS VARCHAR)" if number else f"CAST({ends[e]} AS VARCHAR)" for e in ends]
    kinds = "CAST(NULL AS BIGINT)" if c in _REAL else f"count(DISTINCT {c})"
    return f"""SELECT load_no, '{c}' AS column_name, count(*) AS n_rows, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 9) AS null_rate,
      round(count(*) FILTER (WHERE {c} IS NOT NULL AND {nan}) / count(*), 9) AS nan_rate, {kinds} AS n_distinct,
      {numbers[0]} AS min_number, {numbers[1]} AS max_number, {texts[0]} AS min_text, {texts[1]} AS max_text
      FROM air_daily WHERE load_no IS NOT NULL GROUP BY load_no"""


ORACLE = {
    "p2_negative": "SELECT DISTINCT reading_id FROM air_hourly WHERE value_ugm3 < 0 AND NOT isinf(value_ugm3) AND reading_id IS NOT NULL",
    "p5_rates": " UNION ALL ".join(_rates_sql(c) for c in _TEXTS[:4] + _ODD + _REAL + _TEXTS[4:]),
    "p2_pairs": "SELECT DISTINCT pair_id FROM air_pairs WHERE pm2_5 > 1.2 * pm10 AND NOT isnan(pm2_5) AND NOT isnan(pm10) AND pair_id IS NOT NULL",
    "p4_found": f"""
WITH {_USED}
SELECT g.station_id, g.parameter, g.hour_epoch FROM grid g
LEFT JOIN means m ON g.station_id = m.station_id AND g.parameter = m.parameter AND g.hour_epoch = m.h
WHERE m.n IS NULL""",
    "p4_regular_series": f"""
WITH {_USED},
joined AS (
  SELECT g.station_id, g.parameter, g.hour_epoch, m.mean, coalesce(m.n, 0) AS n_readings,
         g.hour_epoch - row_number() OVER (PARTITION BY g.station_id, g.parameter ORDER BY g.hour_epoch) AS island
  FROM grid g LEFT JOIN means m ON g.station_id = m.station_id AND g.parameter = m.parameter AND g.hour_epoch = m.h),
filled AS (
  SELECT *, last_value(mean IGNORE NULLS) OVER (PARTITION BY station_id, parameter, island ORDER BY hour_epoch
                                               RANGE BETWEEN {MAX_GAP} PRECEDING AND CURRENT ROW) AS v FROM joined)
SELECT station_id, parameter, hour_epoch, round(v, 6) AS value, CAST(n_readings AS BIGINT) AS n_readings,
       CASE WHEN n_readings > 0 THEN 'observed' WHEN v IS NOT NULL THEN 'carried' ELSE 'missing' END AS status
FROM filled""",
    "p4_hours_per_day": f"""
WITH {_USED}
SELECT g.station_id, g.parameter, CAST(DATE '1970-01-01' + CAST(floor((g.hour_epoch + 5) / 24) AS INTEGER) AS DATE) AS local_date,
       count(m.n) AS n_hours
FROM grid g LEFT JOIN means m ON g.station_id = m.station_id AND g.parameter = m.parameter AND g.hour_epoch = m.h
GROUP BY ALL""",
}
