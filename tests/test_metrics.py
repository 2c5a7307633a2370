import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import compare, metrics, ml, stats


def test_regression_metrics_with_nulls_negative_r2_and_constant_target(spark):
    rows = [("m", 1.0, 2.0), ("m", 2.0, 5.0), ("m", 4.0, -3.0), ("m", None, 1.0), ("m", 1.0, None), ("c", 3.0, 3.0), ("c", 3.0, 3.0), ("d", 3.0, 4.0)]
    got = {r["model"]: r for r in metrics.regression_metrics(spark.createDataFrame(rows, "model string, actual double, predicted double"), ["model"]).collect()}
    y, p = np.array([1.0, 2, 4]), np.array([2.0, 5, -3])
    assert got["m"]["n"] == 3
    assert got["m"]["mae"] == pytest.approx(np.abs(y - p).mean())
    assert got["m"]["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["m"]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["m"]["r2"] < 0
    assert (got["c"]["r2"], got["d"]["r2"]) == (1.0, 0.0)


def test_macro_f1_counts_absent_labels(spark):
    long = spark.createDataFrame([("car", "car"), ("car", "bus"), ("bus", "bus")], "actual string, predicted string")
    got = metrics.macro_f1(metrics.confusion(long, [], ["bus", "car", "truck"]), []).first()
    assert got["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    assert got["accuracy"] == pytest.approx(2 / 3)


def test_spearman_matches_pandas(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": r.integers(0, 9, 200).astype(float), "b": r.normal(size=200), "c": r.integers(0, 4, 200).astype(float)})
    pdf["b"] += pdf["a"]
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    want = pdf.corr(method="spearman")
    for row in stats.spearman(df, ["a", "b", "c"]).collect():
        assert row["rho"] == pytest.approx(want.loc[row["a"], row["b"]])


def test_block_bootstrap_matches_numpy(spark):
    r = np.random.default_rng(2)
    days, block, reps = 60, 7, 40
    values = r.normal(size=days)
    values[[5, 17, 18]] = np.nan
    starts = np.random.default_rng(42).integers(0, days - block + 1, size=(reps, -(-days // block)))
    index = (starts[:, :, None] + np.arange(block)).reshape(reps, -1)[:, :days]
    want = np.nanmean(values[index], axis=1)
    daily = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values) if v == v], "day int, v double")
    got = stats.block_bootstrap(daily, stats.numpy_block_draws(spark, reps, days, block), block, days, "day", "v")
    assert [x["mean_value"] for x in got.orderBy("rep").collect()] == pytest.approx(want.tolist())


def regression(n=120, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [1.0, -0.5, 4.0] + r.normal(size=n)
    return x, y


def test_ridge_is_the_closed_form(spark):
    x, y = regression()
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "y"]))
    for alpha in (0.1, 10.0):
        fitted = ml.fit_ridge(df, ["a", "b", "c"], "y", alpha)
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
        assert fitted.model.coefficients.toArray() == pytest.approx(w, abs=1e-8)
        got = fitted.predict(df, "p").toPandas()["p"].to_numpy()
        assert got == pytest.approx(z @ w + y.mean(), abs=1e-8)


def test_preparation_medians_flags_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (4.0, 8.0, 5.0)], "a double, b double, c double")
    ready = ml.prepare(df, ["a", "b", "c"])
    assert ready.medians == {"a": 2.5, "b": 6.0, "c": 5.0}
    assert ready.flagged == ["b"]
    assert ready.stds["x_c"] == 1.0


def test_logistic_reaches_the_optimum(spark):
    x, y = regression(150, 3)
    label = np.digitize(y, np.quantile(y, [0.3, 0.7]))
    names = ["u", "v", "w"]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(k=[names[i] for i in label])
    fitted = ml.fit_logistic(spark.createDataFrame(pdf), ["a", "b", "c"], "k", names, 1.0)
    z = (x - x.mean(0)) / x.std(0)
    w, b = fitted.model.coefficientMatrix.toArray(), fitted.model.interceptVector.toArray()
    s = z @ w.T + b
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    weight = len(label) / (3 * np.bincount(label))[label]
    gradient = ((p - np.eye(3)[label]) * weight[:, None]).T @ z + w
    assert np.abs(gradient).max() < 1e-2


def test_picks_ties_and_folds(spark):
    trials = spark.createDataFrame([("b", 0, 1.0), ("a", 1, 1.0), ("c", 2, 3.0)], "model string, trial int, mae double")
    assert ml.first_best(trials, "mae", "trial").first()["model"] == "b"
    df = spark.createDataFrame([(g, "x" if g % 3 else "y") for g in range(200) for _ in range(1 + g % 4)], "g long, k string")
    folds = ml.stratified_group_folds(df, "g", "k").collect()
    assert len(folds) == 200
    sizes = [sum(1 for r in folds if r["fold"] == f) for f in range(5)]
    assert max(sizes) - min(sizes) <= 10
    assert ml.majority_class(df, "k").first()["majority"] == "x"
    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "g long, i long")
    got = compare.first_k_per_group(rows, ["g"], ["i"], 2).collect()
    assert sorted((r["g"], r["i"], r["rank"]) for r in got) == [(0, 0, 1), (0, 3, 2), (1, 1, 1), (1, 4, 2), (2, 2, 1), (2, 5, 2)]


def test_permutation_importance_ranks_the_features(spark):
    x, y = regression(80, 5)
    pdf = pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "y"])
    pdf["row_id"] = range(80)
    df = spark.createDataFrame(pdf)
    fitted = ml.fit_ridge(df, ["a", "b", "c"], "y", 1.0)
    got = {r["feature"]: r["rise_mean"] for r in ml.permutation_importance(fitted, df, ["a", "b", "c"], "y", repeats=2).collect()}
    assert got["b"] > got["c"] > 0


def test_saved_models_predict_the_same(spark, tmp_path):
    x, y = regression(60, 7)
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "y"]))
    for name, fitted in (("ridge", ml.fit_ridge(df, ["a", "b"], "y", 1.0)), ("forest", ml.fit_forest(df, ["a", "b"], "y", 3, trees=3))):
        ml.save(fitted, str(tmp_path / name))
        again = ml.load(str(tmp_path / name))
        assert again.predict(df, "p").toPandas()["p"].tolist() == fitted.predict(df, "p").toPandas()["p"].tolist()
