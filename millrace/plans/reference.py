"""Queries of the daily, comparison and series operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.functions.times import readable_time
from millrace.operators import compare, daily, ranks, series
from millrace.sources.tables import clean, table

QUERIES, ORACLE = {}, {}
#: All event types of the table.
EVENTS = ["click", "error", "purchase", "signup", "view"]
GATE = 22
#: Daily limits by parameter: guideline and national, µg/m³ (fixed values).
LIMITS = {
    "guideline": {"pm2_5": 15.0, "pm10": 45.0, "no2": 25.0, "so2": 40.0, "co": 4000.0},
    "national": {"pm2_5": 35.0, "pm10": 60.0, "no2": 40.0, "so2": 50.0, "co": 3000.0},
}
_LIMIT_SQL = ", ".join(f"('{s}', '{p}', {x})" for s, ps in LIMITS.items() for p, x in ps.items())
_TIME_SQL = r"""CASE WHEN regexp_matches(trim(datetime_utc), '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$')
  THEN TRY_CAST(regexp_replace(trim(datetime_utc), '([+-][0-9]{2})([0-9]{2})$', '\1:\2') AS TIMESTAMPTZ) END"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def order_days(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by day: (series, day, total); 'all' is the one series."""
    rows = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    days = rows.groupBy("day").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return days.select(F.lit("all").alias("series"), "day", "total")


ORDER_DAYS = "days AS (SELECT 'all' AS series, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 2)"
DENSE = ORDER_DAYS + """,
dense AS (SELECT 'all' AS series, CAST(g.d AS DATE) AS day, days.total
  FROM (SELECT unnest(generate_series((SELECT min(day) FROM days), (SELECT max(day) FROM days), INTERVAL 1 DAY)) AS d) g
  LEFT JOIN days ON days.day = CAST(g.d AS DATE))"""


@query(f"""
WITH d AS (SELECT event_type, CAST(ts + INTERVAL 5 HOUR AS DATE) AS local_date, avg(value) AS m, count(DISTINCT date_trunc('hour', ts)) AS n_hours
  FROM events GROUP BY ALL)
SELECT event_type, local_date, round(m, 9) AS mean_value, n_hours, n_hours >= {GATE} AS valid_day,
       CASE WHEN n_hours >= {GATE} THEN round(m, 9) END AS value FROM d""")
def daily_gated_mean(spark, folder):
    events = clean(spark, folder, "events")
    out = daily.gated_daily_means(events, ["event_type"], F.col("ts"), "value", daily.local_date(F.col("ts"), "+05:00"), GATE)
    return rounded(out, "mean_value", "value", digits=9)


@query(f"""
WITH r AS (SELECT station_id, parameter, reading_id, value_ugm3 AS v, {_TIME_SQL} AS t FROM air_hourly),
u AS (SELECT DISTINCT * FROM r WHERE t IS NOT NULL AND v >= 0 AND NOT isnan(v) AND NOT isinf(v)),
d AS (SELECT station_id, parameter, CAST((t AT TIME ZONE 'UTC') + INTERVAL 5 HOUR AS DATE) AS local_date, avg(v) AS m,
             count(DISTINCT floor(epoch(t) / 3600)) AS n_hours FROM u GROUP BY ALL)
SELECT station_id, parameter, local_date, round(m, 9) AS mean_value, n_hours, n_hours >= 18 AS valid_day,
       CASE WHEN n_hours >= 18 THEN round(m, 9) END AS value FROM d""")
def air_daily_means(spark, folder):
    rows = clean(spark, folder, "air_hourly").select(
        "station_id", "parameter", "reading_id", F.col("value_ugm3").alias("v"), readable_time("datetime_utc").alias("t")
    )
    usable = rows.filter(~numbers.invalid_reading(F.col("t"), F.col("v"))).distinct()
    out = daily.gated_daily_means(usable, ["station_id", "parameter"], F.col("t"), "v", daily.local_date(F.col("t"), "+05:00"))
    return rounded(out, "mean_value", "value", digits=9)


@query("""
WITH a AS (SELECT city, station_id, parameter, year(local_date) AS year, valid_day FROM air_daily WHERE valid_day IS NOT NULL)
SELECT *, round(valid_days / dayofyear(make_date(CAST(year AS INTEGER), 12, 31)), 6) AS coverage FROM (
  SELECT city, station_id, parameter, year, count(*) AS days, count(*) FILTER (WHERE valid_day) AS valid_days, round(avg(CAST(valid_day AS INTEGER)), 6) AS valid_share
  FROM a GROUP BY ALL)""")
def coverage_by_year(spark, folder):
    rows = clean(spark, folder, "air_daily").filter("valid_day IS NOT NULL")
    out = daily.yearly_coverage(rows, ["city", "station_id", "parameter"])
    return rounded(out.withColumn("year", F.col("year").cast("long")), "valid_share", "coverage")


@query(f"""
WITH lim(standard, parameter, threshold) AS (VALUES {_LIMIT_SQL}),
v AS (SELECT city, parameter, value_ugm3 FROM air_daily WHERE value_ugm3 IS NOT NULL AND NOT isnan(value_ugm3))
SELECT city, parameter, standard, CAST(threshold AS DOUBLE) AS threshold, count(*) AS n,
       count(*) FILTER (WHERE value_ugm3 > threshold) AS above, round(100.0 * count(*) FILTER (WHERE value_ugm3 > threshold) / count(*), 6) AS above_pct
FROM v JOIN lim USING (parameter) GROUP BY ALL""")
def exceedance_by_city(spark, folder):
    return rounded(compare.exceedances(clean(spark, folder, "air_daily"), ["city"], "parameter", "value_ugm3", LIMITS), "above_pct")


@query("""
WITH l AS (UNPIVOT (SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount FROM lineitem)
           ON l_quantity, l_extendedprice, l_discount INTO NAME measure VALUE x)
SELECT l_returnflag, l_linestatus, measure, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std,
       min(x) AS min, median(x) AS median, max(x) AS max FROM l GROUP BY ALL""")
def group_summary_stats(spark, folder):
    rows = table(spark, folder, "lineitem")
    out = compare.summary_stats(rows, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(out, "mean", "std", digits=4)


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS p50 FROM lineitem GROUP BY ALL""")
def quantiles_p90_p99(spark, folder):
    out = compare.quantiles(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p90": 0.9, "p99": 0.99, "p50": 0.5})
    return rounded(out, "p90", "p99", "p50")


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM events WHERE event_type IS NOT NULL GROUP BY ALL),
w AS (SELECT day, """ + ", ".join(f"max(v) FILTER (WHERE event_type = '{e}') AS {e}" for e in EVENTS) + """ FROM d GROUP BY day)
SELECT day, """ + ", ".join(f"round({e}, 6) AS {e}" for e in EVENTS) + " FROM w WHERE " + " AND ".join(f"{e} IS NOT NULL" for e in EVENTS))
def common_dates_compare(spark, folder):
    rows = clean(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return rounded(compare.common_dates(rows, "day", "event_type", EVENTS, "value"), *EVENTS)


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, " + ", ".join(f"round(avg(o_totalprice) FILTER (WHERE month(o_orderdate) = {m}), 4) AS m{m}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
def pivot_year_month(spark, folder):
    out = compare.pivot_means(table(spark, folder, "orders"), F.year("o_orderdate"), "year", F.month("o_orderdate"), list(range(1, 13)), "o_totalprice", "m")
    return rounded(out, *[f"m{m}" for m in range(1, 13)], digits=4)


@query(f"""
WITH {ORDER_DAYS},
m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, avg(total) AS v, count(total) AS n FROM days GROUP BY 1),
g AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT 'all' AS series, g.month, round(m.v, 6) AS mean_value, coalesce(m.n, 0) AS n FROM g LEFT JOIN m ON g.month = m.month""")
def monthly_resample(spark, folder):
    return rounded(daily.monthly_means(order_days(spark, folder), ["series"], "day", "total"), "mean_value")


@query("""
SELECT city, parameter, year(local_date) AS year,
  CASE WHEN month(local_date) IN (12, 1, 2) THEN 'winter' WHEN month(local_date) <= 5 THEN 'spring' WHEN month(local_date) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
  count(v) AS n, round(avg(v), 6) AS mean_value, round(median(v), 6) AS median_value
FROM (SELECT *, CASE WHEN isnan(value_ugm3) THEN NULL ELSE value_ugm3 END AS v FROM air_daily) GROUP BY ALL""")
def seasonal_summary(spark, folder):
    out = daily.seasonal_summary(clean(spark, folder, "air_daily"), ["city", "parameter"], "local_date", "value_ugm3")
    return rounded(out.withColumn("year", F.col("year").cast("long")), "mean_value", "median_value")


@query("""
WITH p AS (SELECT l_orderkey, l_returnflag, CAST(l_shipdate AS DATE) AS local_date, l_quantity AS fine, l_extendedprice / 2000.0 AS coarse FROM lineitem),
d AS (SELECT l_returnflag, local_date, count(*) AS k, avg(fine) AS f, avg(coarse) AS c FROM p GROUP BY ALL HAVING count(*) >= 5)
SELECT l_returnflag, count(*) AS paired_days, count(*) FILTER (WHERE f > c) AS above_days,
       count(*) FILTER (WHERE f > 1.2 * c) AS far_above_days, round(100.0 * count(*) FILTER (WHERE f > c) / count(*), 6) AS above_pct
FROM d GROUP BY ALL""")
def cross_measure_days(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("local_date"), F.col("l_quantity").alias("fine"), (F.col("l_extendedprice") / 2000.0).alias("coarse"))
    return rounded(daily.paired_day_quality(rows, ["l_returnflag"], "fine", "coarse", 5), "above_pct")


@query("""
SELECT station_id, count(*) AS n, count(*) FILTER (WHERE pm2_5 > pm10) AS above, count(*) FILTER (WHERE pm2_5 > 1.2 * pm10) AS far_above,
       round(avg(CAST(pm2_5 > pm10 AS INTEGER)), 6) AS above_share
FROM (SELECT DISTINCT pair_id, station_id, pm2_5, pm10 FROM air_pairs WHERE pm2_5 IS NOT NULL AND pm10 IS NOT NULL AND NOT isnan(pm2_5) AND NOT isnan(pm10)) GROUP BY ALL""")
def cross_measure_flags(spark, folder):
    rows = clean(spark, folder, "air_pairs").filter("pm2_5 IS NOT NULL AND pm10 IS NOT NULL").select("pair_id", "station_id", "pm2_5", "pm10").distinct()
    above = F.col("pm2_5") > F.col("pm10")
    out = rows.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(above).alias("above"), F.count_if(F.col("pm2_5") > 1.2 * F.col("pm10")).alias("far_above"), F.avg(above.cast("int")).alias("above_share")
    )
    return rounded(out, "above_share")


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS v, count(DISTINCT date_trunc('hour', ts)) AS h FROM events
           WHERE event_type IS NOT NULL GROUP BY ALL),
x AS (SELECT m.min_hours, d.* FROM d, (VALUES (20), (23)) m(min_hours) WHERE h >= min_hours),
c AS (SELECT min_hours, day FROM x GROUP BY ALL HAVING count(DISTINCT event_type) = 5)
SELECT x.min_hours, event_type, count(DISTINCT x.day) AS common_days, round(avg(v), 6) AS mean_value, round(median(v), 6) AS median_value
FROM x JOIN c ON x.min_hours = c.min_hours AND x.day = c.day GROUP BY ALL""")
def completeness_sensitivity(spark, folder):
    days = daily.gated_daily_means(clean(spark, folder, "events"), ["event_type"], F.col("ts"), "value", F.to_date("ts"))
    out = daily.completeness_sensitivity(days, "event_type", EVENTS, "local_date", "mean_value", "n_hours", [20, 23])
    return rounded(out, "mean_value", "median_value")


@query(f"""
WITH r AS (SELECT parameter, station_id, reading_id, value_ugm3 AS v, raw_value AS raw, {_TIME_SQL} AS t, coalesce(trim(city) IN ('Atyrau', 'Aktau'), false) AS chosen,
           CASE WHEN raw_unit IN ('mg/m3', 'мг/м³') THEN 1000.0 WHEN raw_unit IN ('µg/m3', 'ug/m3') THEN 1.0 END AS factor FROM air_hourly),
s AS (SELECT *, CASE WHEN NOT chosen THEN 0 WHEN t IS NULL OR v IS NULL OR isnan(v) OR isinf(v) OR v < 0 THEN 1
                     WHEN raw IS NULL OR factor IS NULL OR NOT (abs(raw * factor - v) <= 0.001 + 0.000001 * abs(v)) THEN 2 ELSE 3 END AS st FROM r),
k AS (SELECT parameter, st, station_id, reading_id, count(*) AS n, min(t) AS t, max(CAST(CAST(t AT TIME ZONE 'UTC' AS DATE) BETWEEN DATE '2018-01-01' AND DATE '2024-12-31' AS INTEGER)) AS inside
      FROM s WHERE st = 3 GROUP BY ALL),
a AS (SELECT parameter, count(*) AS raw_rows, count(*) FILTER (WHERE st > 0) AS selected_rows, count(*) FILTER (WHERE st = 1) AS invalid_rows, count(*) FILTER (WHERE st = 2) AS unit_rows FROM s GROUP BY ALL),
c AS (SELECT parameter, sum(n - 1) AS duplicate_rows, sum(inside) AS retained_rows FROM k GROUP BY ALL),
d AS (SELECT parameter, station_id, CAST((t + INTERVAL 5 HOUR) AT TIME ZONE 'UTC' AS DATE) AS day, count(DISTINCT t) AS h FROM k WHERE inside = 1 GROUP BY ALL),
e AS (SELECT parameter, count(*) AS station_days, count(*) FILTER (WHERE h >= 18) AS valid_station_days FROM d GROUP BY ALL)
SELECT a.parameter, raw_rows, selected_rows, invalid_rows, unit_rows, CAST(coalesce(duplicate_rows, 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(retained_rows, 0) AS BIGINT) AS retained_rows,
       coalesce(station_days, 0) AS station_days, coalesce(valid_station_days, 0) AS valid_station_days
FROM a LEFT JOIN c ON a.parameter IS NOT DISTINCT FROM c.parameter LEFT JOIN e ON a.parameter IS NOT DISTINCT FROM e.parameter""")
def cleaning_audit(spark, folder):
    rows = table(spark, folder, "air_hourly")
    unit = F.when(F.col("raw_unit").isin("mg/m3", "мг/м³"), 1000.0).when(F.col("raw_unit").isin("µg/m3", "ug/m3"), 1.0)
    local = F.to_date(F.expr("_t + INTERVAL 5 HOURS"))
    chosen = F.trim("city").isin("Atyrau", "Aktau")
    keys = ["station_id", "reading_id"]
    return daily.cleaning_audit(rows, "parameter", keys, readable_time("datetime_utc"), "value_ugm3", "raw_value", unit, "2018-01-01", "2024-12-31", chosen, local=local)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM vehicle_objects" for c in ("object_id", "image_id", "scene_group", "vehicle_class", "category_id", "iscrowd", "license_id", "image_width", "image_height", "bbox_x", "bbox_y", "bbox_width", "bbox_height", "crop_path", "image_path", "image_sha256", "image_phash", "split")) + ")")
def null_profile(spark, folder):
    return compare.null_profile(table(spark, folder, "vehicle_objects"))


@query(f"WITH {DENSE} SELECT series, day, total FROM dense")
def calendar_densify(spark, folder):
    return series.densify(order_days(spark, folder), ["series"], "day").select("series", "day", "total")


@query(f"""WITH {DENSE} SELECT series, day, total, {", ".join(f"lag(total, {k}) OVER (ORDER BY day) AS lag{k}" for k in (1, 2, 3, 7, 14))} FROM dense""")
def lag_features(spark, folder):
    return series.lags(calendar_densify(spark, folder), ["series"], "day", "total", [1, 2, 3, 7, 14])


def _rolling_sql(w: int, least: int, what: str, name: str) -> str:
    over = f"OVER (ORDER BY day ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(total) {over} >= {least} THEN round({what}(total) {over}, 6) END AS {name}"


@query(f"""WITH {DENSE} SELECT series, day, total, {_rolling_sql(3, 2, 'avg', 'rolling_mean3')}, {_rolling_sql(7, 3, 'avg', 'rolling_mean7')},
{_rolling_sql(14, 7, 'avg', 'rolling_mean14')}, {_rolling_sql(7, 3, 'stddev_samp', 'rolling_std7')} FROM dense""")
def rolling_features(spark, folder):
    out = series.rolling(calendar_densify(spark, folder), ["series"], "day", "total", {3: 2, 7: 3, 14: 7}, {7: 3})
    return rounded(out, "rolling_mean3", "rolling_mean7", "rolling_mean14", "rolling_std7")


_ISLAND = "i AS (SELECT *, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM days)"


@query(f"""WITH {ORDER_DAYS}, {_ISLAND},
f AS (SELECT *, {", ".join(f"lag(total, {k}) OVER w AS b{k}" for k in range(1, 8))}, avg(total) OVER w3 AS a3, count(total) OVER w3 AS c3,
      avg(total) OVER w7 AS a7, count(total) OVER w7 AS c7 FROM i
      WINDOW w AS (PARTITION BY island ORDER BY day), w3 AS (PARTITION BY island ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
             w7 AS (PARTITION BY island ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT series, day, total, CAST(island AS DATE) AS island, b1 AS value_lag1, round(total - b1, 4) AS delta_target, round((b1 - b7) / 6, 4) AS mean_change7,
       round(b1 - b2, 4) AS delta_lag1, round(b2 - b3, 4) AS delta_lag2, round(b3 - b4, 4) AS delta_lag3,
       round(CASE WHEN c3 = 3 THEN b1 - a3 END, 4) AS deviation_mean3, round(CASE WHEN c7 = 7 THEN b1 - a7 END, 4) AS deviation_mean7 FROM f""")
def islands(spark, folder):
    out = series.island_features(order_days(spark, folder), ["series"], "day", "total")
    return rounded(out, "delta_target", "mean_change7", "delta_lag1", "delta_lag2", "delta_lag3", "deviation_mean3", "deviation_mean7", digits=4)


@query(f"""WITH {ORDER_DAYS},
d AS (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) = 1 THEN total - lag(total) OVER (ORDER BY day) END AS delta FROM days)
SELECT count(delta) AS n, round(quantile_cont(abs(delta), 0.99), 4) AS threshold FROM d""")
def continuity_threshold(spark, folder):
    out = series.continuity_diff(order_days(spark, folder), ["series"], "day", "total")
    return out.agg(F.count("delta").alias("n"), F.round(F.percentile(F.abs("delta"), F.lit(0.99)), 4).alias("threshold"))


@query(f"""WITH {ORDER_DAYS}
SELECT series, day, round(sin(2 * pi() * dayofyear(day) / 365.25), 9) AS sin_doy, round(cos(2 * pi() * dayofyear(day) / 365.25), 9) AS cos_doy,
       round(sin(2 * pi() * (isodow(day) - 1) / 7), 9) AS sin_week, round(cos(2 * pi() * (isodow(day) - 1) / 7), 9) AS cos_week FROM days""")
def cyclic_calendar(spark, folder):
    out = order_days(spark, folder).select("series", "day", *[F.round(c, 9).alias(n) for n, c in numbers.cyclic_calendar(F.col("day")).items()])
    return out


@query(f"""WITH {DENSE}
SELECT series, day, total, CASE WHEN day >= DATE '2000-01-01' THEN 'test' WHEN day >= DATE '1999-01-01' THEN 'validation' ELSE 'train' END AS split,
       lag(total, 1) OVER w AS persistence, lag(total, 7) OVER w AS seasonal_naive7, round(2 * lag(total, 1) OVER w - lag(total, 2) OVER w, 4) AS drift
FROM dense WINDOW w AS (ORDER BY day)""")
def baseline_forecasts(spark, folder):
    out = series.baselines(calendar_densify(spark, folder), ["series"], "day", "total")
    out = out.withColumn("split", series.chronological_split(F.col("day"), "1999-01-01", "2000-01-01"))
    return rounded(out, "drift", digits=4)


@query("""
SELECT station_id, parameter, load_no, mean_ugm3 FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id, parameter ORDER BY received_at, load_no, local_date, city NULLS FIRST, mean_ugm3 NULLS FIRST) AS r
  FROM (SELECT station_id, parameter, load_no, received_at, local_date, city, CASE WHEN isnan(mean_ugm3) THEN NULL ELSE mean_ugm3 END AS mean_ugm3 FROM air_daily)) WHERE r = 1""")
def keep_first_row(spark, folder):
    rows = clean(spark, folder, "air_daily").select("station_id", "parameter", "load_no", "received_at", "local_date", "city", "mean_ugm3")
    out = compare.keep_first(rows, ["station_id", "parameter"], ["received_at", "load_no", "local_date", "city", "mean_ugm3"])
    return out.select("station_id", "parameter", "load_no", "mean_ugm3")


@query("SELECT CAST(count(*) - count(DISTINCT reading_id) AS BIGINT) AS duplicates, count(DISTINCT reading_id) AS keys FROM air_hourly WHERE reading_id IS NOT NULL")
def duplicate_readings(spark, folder):
    return compare.duplicate_count(table(spark, folder, "air_hourly").filter("reading_id IS NOT NULL"), ["reading_id"])


@query("""
SELECT l_returnflag, CAST(least(floor((l_extendedprice - 900) / 4000) + 1, 25) AS BIGINT) AS bin, count(*) AS n
FROM lineitem WHERE l_extendedprice BETWEEN 900 AND 100900 GROUP BY ALL""")
def histogram_bins(spark, folder):
    return compare.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 900, 100900, 25, ["l_returnflag"])


@query("SELECT vehicle_class, " + ", ".join(f"count(*) FILTER (WHERE category_id = {c}) AS n_{c}" for c in (3, 6, 8)) + " FROM vehicle_objects GROUP BY ALL")
def class_crosstab(spark, folder):
    return compare.crosstab(table(spark, folder, "vehicle_objects"), "vehicle_class", "category_id", [3, 6, 8])


_STEPS = [("all", "true"), ("wide", "bbox_width >= 40"), ("high", "bbox_height >= 40"), ("single", "iscrowd = 0"), ("licensed", "license_id IN (1, 4, 5)")]


@query(" UNION ALL ".join(
    f"SELECT {n} AS step, '{name}' AS name, count(*) AS n_rows, count(DISTINCT image_id) AS n_distinct FROM vehicle_objects WHERE {' AND '.join('(' + c + ')' for _, c in _STEPS[: n + 1])}"
    for n, (name, _) in enumerate(_STEPS)))
def eligibility_funnel(spark, folder):
    return compare.funnel(table(spark, folder, "vehicle_objects"), [(name, F.expr(c)) for name, c in _STEPS], "image_id")


@query("""
SELECT vehicle_class, count(*) AS n, count(DISTINCT image_id) AS images, min(bbox_width) AS width_min, round(median(bbox_width), 6) AS width_median, max(bbox_width) AS width_max,
       min(bbox_height) AS height_min, round(median(bbox_height), 6) AS height_median, max(bbox_height) AS height_max FROM vehicle_objects GROUP BY ALL""")
def class_sizes(spark, folder):
    rows = table(spark, folder, "vehicle_objects")
    sizes = [f(f"bbox_{s}").alias(f"{s}_{n}") for s in ("width", "height") for n, f in (("min", F.min), ("max", F.max))]
    out = rows.groupBy("vehicle_class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("images"), *sizes)
    for s in ("width", "height"):
        out = ranks.same_keys(out, compare.quantiles(rows, ["vehicle_class"], f"bbox_{s}", {f"{s}_median": 0.5}), ["vehicle_class"])
    return rounded(out, "width_median", "height_median")


@query("SELECT license_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM vehicle_objects), 9) AS share FROM vehicle_objects GROUP BY ALL")
def license_counts(spark, folder):
    return rounded(compare.value_counts(table(spark, folder, "vehicle_objects"), ["license_id"]), "share", digits=9)


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def largest_orders(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return compare.top_k(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 15)


@query("SELECT lang, doc_id, CAST(r AS INTEGER) AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def first_k_per_group(spark, folder):
    return compare.first_k_per_group(table(spark, folder, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 3)


@query("""
SELECT c_mktsegment, c_custkey, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1""")
def best_per_group(spark, folder):
    return compare.best_by(table(spark, folder, "customer"), ["c_mktsegment"], [-F.col("c_acctbal"), F.col("c_custkey")], ["c_custkey", "c_acctbal"])


@query("""
WITH m AS (SELECT station_id, parameter, CAST(date_trunc('month', local_date) AS DATE) AS month, avg(mean_ugm3) AS a, avg(value_ugm3) AS b
           FROM air_daily WHERE NOT isnan(mean_ugm3) AND NOT isnan(value_ugm3) AND mean_ugm3 IS NOT NULL AND value_ugm3 IS NOT NULL GROUP BY ALL)
SELECT station_id, parameter, month, round(a, 6) AS computed, round(b, 6) AS published, round(abs(a - b), 6) AS difference, abs(a - b) <= 0.51 AS agrees FROM m""")
def reconcile_months(spark, folder):
    rows = clean(spark, folder, "air_daily").filter("mean_ugm3 IS NOT NULL AND value_ugm3 IS NOT NULL")
    keys = ["station_id", "parameter", "month"]
    rows = rows.withColumn("month", F.trunc("local_date", "month").cast("date"))
    a, b = (rows.groupBy(*keys).agg(F.avg(c).alias(n)) for c, n in (("mean_ugm3", "computed"), ("value_ugm3", "published")))
    return rounded(compare.reconcile(a, b, keys, "computed", "published", 0.51), "computed", "published", "difference")


@query("""
SELECT object_id, greatest(0, CAST(trunc(bbox_x) AS INTEGER)) AS crop_left, greatest(0, CAST(trunc(bbox_y) AS INTEGER)) AS crop_top,
       least(image_width, CAST(trunc(bbox_x + bbox_width + 0.999) AS INTEGER)) AS crop_right, least(image_height, CAST(trunc(bbox_y + bbox_height + 0.999) AS INTEGER)) AS crop_bottom
FROM vehicle_objects WHERE bbox_x IS NOT NULL AND bbox_y IS NOT NULL AND bbox_width IS NOT NULL AND bbox_height IS NOT NULL
  AND NOT isnan(bbox_x) AND NOT isnan(bbox_y) AND NOT isnan(bbox_width) AND NOT isnan(bbox_height)""")
def crop_bounds(spark, folder):
    rows = clean(spark, folder, "vehicle_objects").dropna(subset=["bbox_x", "bbox_y", "bbox_width", "bbox_height"])
    box = numbers.crop_bounds(*[F.col(c) for c in ("bbox_x", "bbox_y", "bbox_width", "bbox_height", "image_width", "image_height")])
    return rows.select("object_id", box.alias("b")).select("object_id", "b.*")
