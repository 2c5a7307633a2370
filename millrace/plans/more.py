"""Small operators as queries of their own: dimensions, flags, coercion, paths, splits, model logs."""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import numbers, text
from millrace.functions.times import readable_time
from millrace.operators import joins, metrics, ml, series
from millrace.plans.models import FEATURES, _frame
from millrace.plans.reference import _TIME_SQL, ORDER_DAYS, order_days, rounded
from millrace.sources import files, scratch
from millrace.sources.tables import clean, table

QUERIES, ORACLE = {}, {}
#: Parameters of the air tables (fixed values).
PARAMETERS = ("pm10", "pm2_5", "no2", "so2", "co", "h2s", "o3")
#: Reference post of each city (fixed values).
REFERENCE = {"Atyrau": "136", "Aktau": "140", "Aktobe": "117"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT DISTINCT station_id, parameter, lat, lon FROM station_metadata WHERE station_id IS NOT NULL")
def station_dimension(spark, folder):
    return table(spark, folder, "station_metadata").filter("station_id IS NOT NULL").select("station_id", "parameter", "lat", "lon").distinct()


@query("""SELECT city, count(*) AS n, count(*) FILTER (WHERE CASE city WHEN 'Atyrau' THEN station_id = '136' WHEN 'Aktau' THEN station_id = '140' WHEN 'Aktobe' THEN station_id = '117' ELSE false END) AS n_reference
FROM air_daily GROUP BY ALL""")
def reference_station_flag(spark, folder):
    flag = F.coalesce(numbers.lookup(F.col("city"), REFERENCE) == F.col("station_id"), F.lit(False))
    return table(spark, folder, "air_daily").groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_reference"))


@query(f"""WITH {ORDER_DAYS}, l AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS shipped FROM lineitem GROUP BY 1)
SELECT d.day, d.total, coalesce(l.shipped, 0) AS shipped FROM days d LEFT JOIN l ON d.day = l.day""")
def left_join_days(spark, folder):
    shipped = table(spark, folder, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("shipped"))
    return order_days(spark, folder).select("day", "total").join(shipped, "day", "left").withColumn("shipped", F.coalesce("shipped", F.lit(0).cast("long")))


@query(f"""WITH {ORDER_DAYS}, s AS (SELECT day, CASE WHEN day >= DATE '2000-01-01' THEN 'test' WHEN day >= DATE '1999-01-01' THEN 'validation' ELSE 'train' END AS split FROM days)
SELECT split, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM s GROUP BY ALL""")
def split_ranges(spark, folder):
    days = order_days(spark, folder).withColumn("split", series.chronological_split(F.col("day"), "1999-01-01", "2000-01-01"))
    return days.groupBy("split").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ORDER_DAYS} SELECT day AS target_date, CAST(day - 1 AS DATE) AS origin_date, strftime(day - 1, '%Y-%m-%d') || 'T00:00:00+05:00' AS origin, total FROM days""")
def forecast_origin(spark, folder):
    origin = F.date_sub("day", 1)
    return order_days(spark, folder).select(F.col("day").alias("target_date"), origin.alias("origin_date"), text.origin_label(origin).alias("origin"), "total")


@query(f"""SELECT reading_id, coalesce(epoch_us({_TIME_SQL}), -1) AS micros, coalesce(TRY_CAST(station_id AS INTEGER), -1) AS station_number FROM air_hourly""")
def safe_coercion(spark, folder):
    return table(spark, folder, "air_hourly").select(
        "reading_id",
        F.coalesce(F.unix_micros(readable_time("datetime_utc")), F.lit(-1).cast("long")).alias("micros"),
        F.expr("coalesce(try_cast(station_id AS int), -1)").alias("station_number"),
    )


@query(r"""
SELECT object_id, image_path, NOT regexp_matches(image_path, '^([A-Za-z][A-Za-z0-9+.-]*:|/)') AND NOT regexp_matches(image_path, '(^|/)[.][.](/|$)') AS inside,
       CAST(nullif(regexp_extract(image_path, '([0-9]+)[.]jpg$', 1), '') AS BIGINT) AS file_id FROM vehicle_objects""")
def path_checks(spark, folder):
    rows = table(spark, folder, "vehicle_objects")
    number = F.expr("try_cast(nullif(regexp_extract(image_path, '([0-9]+)[.]jpg$', 1), '') AS long)")
    return rows.select("object_id", "image_path", text.is_relative_path(F.col("image_path")).alias("inside"), number.alias("file_id"))


@query("""
WITH t AS (SELECT DISTINCT image_id FROM vehicle_objects WHERE lower(trim(split)) = 'train' AND image_id IS NOT NULL), s AS (SELECT DISTINCT image_id FROM vehicle_objects WHERE lower(trim(split)) = 'test' AND image_id IS NOT NULL)
SELECT (SELECT count(*) FROM t) AS train, (SELECT count(*) FROM s) AS test, (SELECT count(*) FROM t SEMI JOIN s ON t.image_id = s.image_id) AS shared""")
def split_overlap(spark, folder):
    rows = table(spark, folder, "vehicle_objects").filter("image_id IS NOT NULL").select("image_id", F.lower(F.trim("split")).alias("s"))
    sides = rows.groupBy("image_id").agg(F.bool_or(F.col("s") == "train").alias("a"), F.bool_or(F.col("s") == "test").alias("b"))
    return sides.agg(F.count_if("a").alias("train"), F.count_if("b").alias("test"), F.count_if(F.col("a") & F.col("b")).alias("shared"))


@query()
def polished_text(spark, folder):
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text.polish(F.col("text"))).alias("polished"))


_TABLES = sorted(
    ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "air_hourly", "air_daily", "air_pairs", "station_metadata"]
    + ["vehicle_objects", "image_pairs", "split_targets", "eval_items", "container_sizes"]
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}.parquet', '{'measurements' if n.startswith('air_') else 'tables'}', {str(n != 'nation').lower()})" for n in _TABLES) + ") t(file, purpose, matches)")
def lock_check(spark, folder):
    """Every file against a stored lock file, in which one hash was changed afterwards."""
    kinds = {r"/air_[a-z]+[.]parquet": "measurements", r"[.]parquet": "tables"}
    found = files.manifest(spark, f"{folder}/*.parquet", purposes=kinds).withColumn("file", F.regexp_extract("path", r"([^/]+[.]parquet)$", 1))
    place = scratch.new_folder(spark, "lock")
    lock = found.select("file", "purpose", F.when(F.col("file") == "nation.parquet", "0").otherwise(F.col("sha256")).alias("expected"))
    files.write_csv(lock, place, single=True)
    stored = spark.read.option("header", True).schema("file string, purpose string, expected string").csv(place)
    return joins.against_lock(found, stored, "file", "sha256", "expected").select("file", "purpose", "matches")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_brand, 'Brand#1')")
def prefix_filter(spark, folder):
    return table(spark, folder, "part").filter(text.has_prefix(F.col("p_brand"), "Brand#1")).select("p_partkey", "p_name")


@query("SELECT p_partkey, '/parts/' || p_name AS path FROM part")
def unquoted_paths(spark, folder):
    url = F.concat(F.lit("https://example.org/parts/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("?v=1"))
    return table(spark, folder, "part").select("p_partkey", text.unquoted_path(url).alias("path"))


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def csv_round_trip(spark, folder):
    """A table written as compressed CSV with a byte-order mark, and read back."""
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    place = scratch.new_folder(spark, "customers")
    files.write_csv(rows, place, gzip=True, mark=True)
    return spark.read.option("header", True).schema(rows.schema).csv(place)


_LEVEL_SQL = "CAST(100 + (dayofyear(date) * 7 + year(date)) % 800 AS INTEGER)"


@query(f"""SELECT CAST(year(date) AS INTEGER) AS year, date, {_LEVEL_SQL} AS level_cm, CASE WHEN day(date) % 9 = 0 THEN '*' ELSE '' END AS marks
FROM (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1996-01-01', DATE '2023-12-31', INTERVAL 1 DAY) t(d))""")
def yearbook_levels(spark, folder):
    """Daily levels read from 28 yearbook pages that are written here from a rule."""
    days = spark.sql("SELECT explode(sequence(DATE'1996-01-01', DATE'2023-12-31')) AS date")
    cells = days.select("date", F.concat(F.expr("CAST(100 + (dayofyear(date) * 7 + year(date)) % 800 AS string)"), F.when(F.day("date") % 9 == 0, " *").otherwise("")).alias("cell"))
    lines = cells.groupBy(F.year("date").alias("year"), F.day("date").alias("d")).agg(F.sort_array(F.collect_list(F.struct(F.month("date"), "cell"))).alias("c"))
    lines = lines.select("year", "d", F.concat(F.col("d").cast("string"), F.lit(" "), F.array_join(F.transform("c", lambda x: x["cell"]), " ")).alias("line"))
    pages = lines.groupBy("year").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("d", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head, tail = "Post 1.2\n1 2 3 4 5 6 7 8 9 10 11 12\n", "\nmean " + " ".join(str(300 + m) for m in range(12))
    return files.level_pages(pages.select("year", F.concat(F.lit(head), "body", F.lit(tail)).alias("text")))[0]


def _search(frame):
    """(trials with validation errors, the fitted models): baselines, four ridges and two forests, in the order that breaks ties."""
    train, validation = frame.filter("split = 'train'"), frame.filter("split = 'validation'")
    rows = [("persistence", None, 0.0), ("drift", None, 0.0)]
    fitted = []
    for kind, values in (("ridge", (0.1, 1.0, 10.0, 100.0)), ("forest", (3, 10))):
        for value in values:
            began = time.perf_counter()
            model = ml.fit_ridge(train, FEATURES, "delta_target", value) if kind == "ridge" else ml.fit_forest(train, FEATURES, "delta_target", value)
            rows.append((kind, float(value), time.perf_counter() - began))
            fitted.append((str(len(rows) - 1), model))
    spark = frame.sparkSession
    n = train.count()
    trials = spark.createDataFrame([(i, str(i), m, p, s, n) for i, (m, p, s) in enumerate(rows)], "trial int, name string, model string, parameter double, fit_seconds double, train_rows long")
    drift = validation.select("total", F.col("value_lag1").alias("0"), (F.col("value_lag1") + F.col("delta_lag1")).alias("1"))
    plain = metrics.regression_metrics(metrics.long_predictions(drift, [], "total", ["0", "1"]), ["model"])
    scores = plain.unionByName(ml.trial_metrics(validation, fitted, "total", "value_lag1")).withColumnRenamed("model", "name")
    return trials.join(scores, "name").drop("name")


@query()
def validation_log(spark, folder):
    """Every candidate of all families with its parameter, seconds of the fit, training rows and validation error."""
    return rounded(_search(_frame(spark, folder)), "mae", "rmse", "r2")


@query()
def frozen_selection(spark, folder):
    """The choice on the validation year, written down before the test, and the test errors of all families refitted on train and validation."""
    frame = _frame(spark, folder)
    trials = scratch.write_cut(_search(frame), "trials").df
    frozen = trials.groupBy("model").agg(F.min_by("parameter", F.struct("mae", "trial")).alias("parameter"), F.min(F.struct("mae", "trial")).alias("best"))
    frozen = scratch.write_cut(frozen.withColumn("selected", F.col("best") == F.min("best").over(Window.partitionBy())), "frozen").df
    kept = {r["model"]: r["parameter"] for r in frozen.collect()}
    fit, test = frame.filter("split <> 'test'"), frame.filter("split = 'test'")
    models = [("ridge", ml.fit_ridge(fit, FEATURES, "delta_target", kept["ridge"])), ("forest", ml.fit_forest(fit, FEATURES, "delta_target", int(kept["forest"])))]
    out = test.withColumns({"persistence": F.col("value_lag1"), "drift": F.col("value_lag1") + F.col("delta_lag1")})
    for name, model in models:
        out = model.predict(out, name, "value_lag1")
    scores = metrics.regression_metrics(metrics.long_predictions(out, [], "total", ["persistence", "drift", "ridge", "forest"]), ["model"])
    return rounded(scores.join(frozen.select("model", "parameter", "selected"), "model"), "mae", "rmse", "r2")


@query()
def frozen_transfer(spark, folder):
    """The frozen penalty, fitted anew on other series: one ridge for each parameter of the air table."""
    rows = clean(spark, folder, "air_daily").filter("value_ugm3 IS NOT NULL AND parameter IS NOT NULL")
    days = rows.groupBy(F.col("parameter").alias("series"), F.col("local_date").alias("day")).agg(F.avg("value_ugm3").alias("total"))
    frame = series.rolling(series.lags(series.densify(days, ["series"], "day"), ["series"], "day", "total", [1, 2, 7]), ["series"], "day", "total", {7: 3}, {})
    frame = frame.filter("total IS NOT NULL").withColumn("split", series.chronological_split(F.col("day"), "2023-01-01", "2024-01-01"))
    frame = scratch.write_cut(frame, "transfer").df
    out = None
    for name in PARAMETERS:
        own = frame.filter(F.col("series") == name)
        fitted = ml.fit_ridge(own.filter("split <> 'test'"), ["lag1", "lag2", "lag7", "rolling_mean7"], "total", 10.0)
        part = fitted.predict(own.filter("split = 'test'"), "ridge", floor=True).select("series", "day", "total", "ridge")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def feature_importances(spark, folder):
    """Rise of the error when a feature is shuffled, beside the forest's impurity importances."""
    frame = _frame(spark, folder)
    names = ["delta_lag1", "deviation_mean7", "mean_change7"]
    fitted = ml.fit_forest(frame.filter("split <> 'test'"), names, "delta_target", 10)
    test = frame.filter("split = 'test'").withColumn("row_id", F.datediff("day", F.lit("1990-01-01").cast("date")).cast("long"))
    rises = ml.permutation_importance(fitted, test, names, "total", "value_lag1")
    impurity = spark.createDataFrame(ml.forest_importances(fitted), "feature string, impurity double")
    return rises.join(impurity, "feature")
