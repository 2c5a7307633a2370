"""Queries that fit models; their results are checked by tests, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.operators import metrics, ml, series
from millrace.plans.reference import order_days
from millrace.sources.scratch import write_cut
from millrace.sources.tables import clean, table

QUERIES, ORACLE = {}, {}
FEATURES = ["value_lag1", "delta_lag1", "delta_lag2", "delta_lag3", "deviation_mean3", "deviation_mean7", "mean_change7", "sin_doy", "cos_doy"]


def _frame(spark, folder):
    rows = series.island_features(order_days(spark, folder), ["series"], "day", "total")
    rows = rows.withColumns(numbers.cyclic_calendar(F.col("day"))).dropna(subset=["deviation_mean7", "delta_lag3"])
    rows = rows.withColumn("split", series.chronological_split(F.col("day"), "1999-01-01", "2000-01-01"))
    # one row a day, read by every fit
    return write_cut(rows, "frame").df


def _scores(frame, fitted, name):
    out = fitted.predict(frame.filter("split = 'test'"), name, "value_lag1")
    return metrics.regression_metrics(metrics.long_predictions(out, [], "total", [name]), ["model"])


def ridge_forecast(spark, folder):
    """Ridge on changes: the penalty with the least validation error, refitted on all before the test."""
    frame = _frame(spark, folder)
    train, validation = frame.filter("split = 'train'"), frame.filter("split = 'validation'")
    trials = [(f"ridge_{n}", ml.fit_ridge(train, FEATURES, "delta_target", a)) for n, a in enumerate((0.1, 1.0, 10.0, 100.0))]
    scores = {r["model"]: r["mae"] for r in ml.trial_metrics(validation, trials, "total", "value_lag1").collect()}
    best = min(trials, key=lambda t: scores.get(t[0], float("inf")))[1]
    final = ml.fit_ridge(frame.filter("split <> 'test'"), FEATURES, "delta_target", best.parameter)
    return _scores(frame, final, "ridge").withColumn("alpha", F.lit(best.parameter))


def forest_forecast(spark, folder):
    frame = _frame(spark, folder)
    return _scores(frame, ml.fit_forest(frame.filter("split <> 'test'"), FEATURES, "delta_target", 3), "forest")


def class_models(spark, folder):
    """Class of a box from its measures by logistic regression, a forest and the majority: (model, macro_f1, accuracy, n) on whole images held out."""
    rows = clean(spark, folder, "vehicle_objects").filter("bbox_width > 0 AND bbox_height > 0 AND image_width > 0 AND image_height > 0")
    width, height = F.col("bbox_width"), F.col("bbox_height")
    features = {
        "log_ratio": F.log(width / height),
        "log_area": F.log(width * height),
        "part_of_image": width * height / (F.col("image_width") * F.col("image_height")),
        "middle_x": (F.col("bbox_x") + width / 2) / F.col("image_width"),
        "middle_y": (F.col("bbox_y") + height / 2) / F.col("image_height"),
    }
    labels, names = ["bus", "car", "truck"], list(features)
    rows = rows.filter(F.col("vehicle_class").isin(labels)).withColumns(features).withColumn("fold", F.pmod(F.xxhash64("image_id"), F.lit(5)))
    rows = write_cut(rows.select("object_id", "vehicle_class", "fold", *names), "boxes").df
    train, test = rows.filter("fold > 0"), rows.filter("fold = 0")
    named = lambda c: F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(c).cast("int") + 1)
    out = ml.fit_logistic(train, names, "vehicle_class", labels, 1.0).predict(test, "p_logistic")
    out = ml.fit_class_forest(train, names, "vehicle_class", labels).predict(out, "p_forest")
    # the models are applied once: the matrix reads its rows twice
    out = write_cut(out.select("vehicle_class", "p_logistic", "p_forest"), "classes").df
    majority = ml.majority_class(train, "vehicle_class").scalar()
    parts = [F.struct(F.lit(m).alias("model"), c.alias("predicted")) for m, c in (("logistic", named("p_logistic")), ("forest", named("p_forest")), ("majority", majority))]
    long = out.select(F.col("vehicle_class").alias("actual"), F.inline(F.array(*parts)))
    return metrics.macro_f1(metrics.confusion(long, ["model"], labels), ["model"])


def grouped_folds(spark, folder):
    rows = table(spark, folder, "vehicle_objects").filter("scene_group > 0")
    folds = ml.stratified_group_folds(rows, "scene_group", "vehicle_class")
    return folds.withColumn("split", ml.fold_split(F.col("fold")))


QUERIES |= {f.__name__: f for f in (ridge_forecast, forest_forecast, class_models, grouped_folds)}
