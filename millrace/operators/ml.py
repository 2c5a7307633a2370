"""Models: exact ridge and logistic regression, forests, frozen selection, importances.

Features enter as plain columns; imputation and scaling are fitted on training rows only, as
expressions in one aggregate, and become part of the fitted object.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import not_below_zero
from millrace.operators import forest as class_forest
from millrace.operators.metrics import long_predictions, regression_metrics
from millrace.operators.ranks import quantiles
from millrace.operators.stats import numbered
from millrace.sources.scratch import write_cut

#: Rows up to which a task holds all values of the features for their medians; those of more rows are ranked in ranges.
MEDIAN_ROWS = 1_000_000


@dataclass
class Preparation:
    """Median imputation with missing flags and population scaling, fitted once."""

    features: list[str]
    medians: dict[str, float]
    flagged: list[str]
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)

    def columns(self) -> dict[str, Column]:
        out = {}
        for c in self.features:
            out[f"x_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
        for c in self.flagged:
            out[f"x_{c}_missing"] = F.col(c).isNull().cast("double")
        if self.means:
            out = {k: (v - F.lit(self.means[k])) / F.lit(self.stds[k]) for k, v in out.items()}
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        ready = df.withColumns(self.columns())
        return VectorAssembler(inputCols=list(self.columns()), outputCol="features").transform(ready)


def prepare(train: DataFrame, features: list[str], scale: bool = True) -> Preparation:
    """Fit medians (interpolated), flags of columns null in training, and population mean and deviation (0 becomes 1)."""
    stats = train.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in features]).first()
    if stats["rows"] <= MEDIAN_ROWS:
        medians = train.agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in features]).first()
    else:
        medians = {c: quantiles(train, [], c, {"m": 0.5}).first()["m"] for c in features}
    ready = Preparation(features, {c: float(medians[c] or 0.0) for c in features}, [c for c in features if stats[f"n_{c}"]])
    if scale:
        wide = train.select(*[v.alias(k) for k, v in ready.columns().items()])
        row = wide.agg(*[F.avg(k).alias(f"a_{k}") for k in wide.columns], *[F.stddev_pop(k).alias(f"s_{k}") for k in wide.columns]).first()
        ready.means = {k: row[f"a_{k}"] for k in wide.columns}
        ready.stds = {k: row[f"s_{k}"] or 1.0 for k in wide.columns}
    return ready


@dataclass
class Fitted:
    """A preparation and a model; predict adds a column, or a row-wise offset plus the model's output."""

    preparation: Preparation
    model: object
    name: str
    parameter: float | None = None

    def predict(self, df: DataFrame, column: str, offset: str | None = None, floor: bool = False) -> DataFrame:
        out = self.model.transform(self.preparation.apply(df))
        value = F.col("prediction") + (F.col(offset) if offset else F.lit(0.0))
        out = out.withColumn(column, not_below_zero(value) if floor else value)
        return out.select(*df.columns, column)


def save(fitted: Fitted, folder: str) -> None:
    """Write the model and its preparation; folder may be on any file system."""
    fitted.model.write().overwrite().save(f"{folder}/model")
    ready = fitted.preparation
    state = json.dumps([ready.features, ready.medians, ready.flagged, ready.means, ready.stds, fitted.name, fitted.parameter, type(fitted.model).__name__])
    SparkSession.active().createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").text(f"{folder}/preparation")


def load(folder: str) -> Fitted:
    """A saved model with its preparation."""
    from pyspark.ml import classification, regression

    state = json.loads(SparkSession.active().read.text(f"{folder}/preparation").first()[0])
    *ready, name, parameter, kind = state
    reader = getattr(regression, kind, None) or getattr(classification, kind)
    return Fitted(Preparation(*ready), reader.load(f"{folder}/model"), name, parameter)


def fit_ridge(train: DataFrame, features: list[str], target: str, alpha: float) -> Fitted:
    """Ridge with penalty alpha on standardised features, equal to the closed form."""
    ready = prepare(train, features)
    data = ready.apply(train.filter(F.col(target).isNotNull()))
    row = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
    # the solver divides the squared error by n and the penalty by the target's deviation
    penalty = alpha * (row["s"] or 1.0) / row["n"]
    model = LinearRegression(labelCol=target, solver="normal", elasticNetParam=0.0, standardization=False, regParam=penalty).fit(data)
    return Fitted(ready, model, "ridge", alpha)


def fit_forest(train: DataFrame, features: list[str], target: str, leaf: int, depth: int = 6, trees: int = 200, seed: int = 42) -> Fitted:
    """Random forest of all features per split; splits are binned, so other libraries' trees differ."""
    ready = prepare(train, features, scale=False)
    data = ready.apply(train.filter(F.col(target).isNotNull()))
    forest = RandomForestRegressor(
        labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=seed
    )
    return Fitted(ready, forest.fit(data), "forest", leaf)


def with_class_index(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col(label))
    return df.withColumn("class_index", (F.when(place > 0, place) - 1).cast("double"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """weight: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    even = counts.agg(F.sum("_n") / F.count(F.lit(1))).scalar()
    weights = counts.select(label, (even / F.col("_n")).alias("weight"))
    return df.join(F.broadcast(weights), label)  # one row a class: joined by shuffle, all rows would meet in a task a class


def fit_logistic(train: DataFrame, features: list[str], label: str, labels: list[str], c: float) -> Fitted:
    """Multinomial logistic regression with inverse penalty c and balanced classes."""
    ready = prepare(train, features)
    data = ready.apply(with_class_index(balanced_weights(train, label), label, labels))
    n = data.count()
    model = LogisticRegression(
        labelCol="class_index", weightCol="weight", family="multinomial", regParam=1.0 / (c * n), standardization=False, maxIter=500, tol=1e-10
    )
    return Fitted(ready, model.fit(data), "logistic", c)


def fit_class_forest(train: DataFrame, features: list[str], label: str, labels: list[str], depth: int = 8, leaf: int = 2, trees: int = 250, seed: int = 42) -> Fitted:
    """Random forest of balanced classes; ceil(sqrt) features per split, splits are binned."""
    ready = prepare(train, features, scale=False)
    data = with_class_index(train.filter(F.col(label).isNotNull()), label, labels).select(*[v.alias(k) for k, v in ready.columns().items()], "class_index")
    return Fitted(ready, class_forest.fit(data, list(ready.columns()), len(labels), depth, leaf, trees, seed), "random_forest", depth)


def majority_class(train: DataFrame, label: str) -> DataFrame:
    """The most common class, the first by name among equals: one row."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(label, F.struct((-F.col("n")).alias("k"), label)).alias("majority"))


def trial_metrics(frame: DataFrame, trials: list[tuple[str, Fitted]], actual: str, offset: str | None) -> DataFrame:
    """Validation metrics of fitted candidates, all in one job."""
    out = frame
    for name, fitted in trials:
        out = fitted.predict(out, name, offset)
    return regression_metrics(long_predictions(out, [], actual, [n for n, _ in trials]), ["model"])


def first_best(trials: DataFrame, measure: str, order: str) -> DataFrame:
    """The trial with the smallest measure; the earlier one of equals."""
    rows = F.struct(*[F.col(c) for c in trials.columns])
    return trials.agg(F.min_by(rows, F.struct(measure, order)).alias("r")).select("r.*")


def permutation_importance(fitted: Fitted, frame: DataFrame, features: list[str], actual: str, offset: str | None = None, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean and deviation of the rise in MAE when a feature's values are shuffled among the rows.

    frame needs a unique column row_id. A shuffle pairs the rows' order with a random order
    by joining two rankings computed once per repeat (row_id is a number).
    """
    base = fitted.predict(frame, "_p", offset)
    start = base.agg(F.avg(F.abs(F.col(actual) - F.col("_p"))).alias("m")).first()["m"]
    ids = frame.select("row_id")
    places = write_cut(numbered(ids, "row_id", "place"), "places").df
    results = None
    for rep in range(repeats):
        # consecutive numbers in two orders: by id, and by a hash of the id
        other = ids.select(F.col("row_id").alias("other_id"), F.xxhash64("row_id", F.lit(seed), F.lit(rep)).alias("h"))
        moves = write_cut(places.join(numbered(other, "h", "place").drop("h"), "place").drop("place"), "moves").df
        for f in features:
            swapped = frame.join(moves, "row_id").drop(f).join(frame.select(F.col("row_id").alias("other_id"), f), "other_id").drop("other_id")
            mae = fitted.predict(swapped, "_p", offset).agg(F.avg(F.abs(F.col(actual) - F.col("_p"))).alias("mae"))
            mae = mae.select(F.lit(f).alias("feature"), (F.col("mae") - F.lit(start)).alias("rise"))
            results = mae if results is None else results.unionByName(mae)
    return results.groupBy("feature").agg(F.avg("rise").alias("rise_mean"), F.stddev_pop("rise").alias("rise_std"))


def forest_importances(fitted: Fitted) -> list[tuple[str, float]]:
    """Impurity importances by feature, largest first."""
    names = [c.removeprefix("x_") for c in fitted.preparation.columns()]
    return sorted(zip(names, fitted.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold): whole groups to folds, class shares alike in all folds.

    Groups of the same size class and main class are ordered by hash and dealt round robin;
    deterministic and distributed, unlike a greedy pass over all groups.
    """
    from pyspark.sql import Window

    counts = df.filter(F.col(group).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy(group).agg(F.max_by(label, F.struct("n", label)).alias("main"), F.sum("n").alias("size"))
    main = main.withColumn("sizes", F.floor(F.log2("size"))).withColumn("h", F.xxhash64(group, F.lit(seed)))
    main = main.withColumn("bucket", F.pmod("h", F.lit(1024)))
    per = main.groupBy("main", "sizes", "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("main", "sizes").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    within = Window.partitionBy("main", "sizes", "bucket").orderBy("h", group)
    ranked = main.withColumn("r", F.row_number().over(within) - 1).join(per, ["main", "sizes", "bucket"])
    return ranked.select(group, F.pmod(F.col("offset") + F.col("r"), F.lit(folds)).cast("int").alias("fold"))


def fold_split(fold: Column) -> Column:
    """Fold 0 is test, fold 1 validation, the rest train."""
    return F.when(fold == 0, "test").when(fold == 1, "validation").when(fold.isNotNull(), "train")
