"""Evaluation metrics as aggregates: regression, classification, improvements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_predictions(df: DataFrame, keep: list[str], actual: str, models: list[str]) -> DataFrame:
    """One row per prediction and model; all models share the one scan."""
    parts = [F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("predicted")) for m in models]
    return df.select(*keep, F.col(actual).cast("double").alias("actual"), F.inline(F.array(*parts)))


def regression_metrics(long: DataFrame, keys: list[str]) -> DataFrame:
    """n, MAE, RMSE and R2 = 1 - SSE / SST of rows with both values.

    R2 may be negative; with a constant target it is 1 for perfect predictions, else 0.
    """
    rows = long.filter("actual IS NOT NULL AND predicted IS NOT NULL")
    error = F.col("actual") - F.col("predicted")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("_sse"),
        (F.var_pop("actual") * F.count(F.lit(1))).alias("_sst"),
    )
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    return sums.withColumn("r2", r2).drop("_sse", "_sst")


def peak_metrics(long: DataFrame, keys: list[str], threshold: DataFrame, name: str) -> DataFrame:
    """Metrics above and not above a threshold taken from another frame; groups of one row are left out.

    threshold: a frame of one row with the column name, taken as a scalar subquery.
    """
    rows = long.withColumn("peak", F.col("actual") > threshold.select(name).scalar())
    return regression_metrics(rows, [*keys, "peak"]).filter("n > 1")


def improvement(metrics: DataFrame, keys: list[str], baseline: str, measure: str = "mae") -> DataFrame:
    """Percent by which each model's measure is below the baseline's, in the same group."""
    base = metrics.filter(F.col("model") == baseline).select(*keys, F.col(measure).alias("_base"))
    joined = metrics.join(base, keys) if keys else metrics.withColumn("_base", base.scalar())
    return joined.withColumn("improvement_pct", 100 * (1 - F.col(measure) / F.col("_base"))).drop("_base")


def confusion(long: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Counts of every (actual, predicted) pair of the labels, absent pairs 0."""
    counts = long.groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in labels])
    frame = long.select(*keys).distinct() if keys else long.sparkSession.range(1).select()
    grid = frame.withColumn("actual", F.explode(names)).withColumn("predicted", F.explode(names))
    joined = grid.join(counts, [*keys, "actual", "predicted"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_report(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class; a zero denominator gives 0."""
    as_actual = matrix.groupBy(*keys, F.col("actual").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp")
    )
    as_predicted = matrix.groupBy(*keys, F.col("predicted").alias("label")).agg(F.sum("n").alias("claimed"))
    both = as_actual.join(as_predicted, [*keys, "label"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    fp, fn = F.col("claimed") - F.col("tp"), F.col("support") - F.col("tp")
    return both.select(
        *keys,
        "label",
        share(F.col("tp"), F.col("claimed")).alias("precision"),
        share(F.col("tp"), F.col("support")).alias("recall"),
        share(2.0 * F.col("tp"), 2.0 * F.col("tp") + fp + fn).alias("f1"),
        "support",
        "tp",
        fp.alias("fp"),
        fn.alias("fn"),
    )


def summary_rows(report: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, macro average and weighted average of a class report, as rows with label."""
    total = report.groupBy(*keys).agg(
        F.sum("support").alias("support"),
        F.sum("tp").alias("tp"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )
    hit = F.col("tp") / F.col("support")
    row = lambda label, p, r, f: F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"))
    rows = [row("accuracy", hit, hit, hit)] + [row(f"{k} avg", *[F.col(f"{k}_{c}") for c in ("precision", "recall", "f1")]) for k in ("macro", "weighted")]
    return total.select(*keys, "support", F.inline(F.array(*rows))).select(*keys, "label", "precision", "recall", "f1", "support")


def macro_f1(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Macro F1 over all labels of the matrix, absent ones included, and accuracy."""
    report = class_report(matrix, keys)
    return report.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.sum("support").alias("n"))


def error_pairs(long: DataFrame, keys: list[str]) -> DataFrame:
    """How often each wrong label stands for each right one."""
    return long.filter(F.col("actual") != F.col("predicted")).groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))

