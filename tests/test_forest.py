import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import forest, ml


def rows_of_classes(spark, n):
    x = spark.range(n).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    return x.withColumn("k", F.when((F.col("a") > 0.9) & (F.col("b") > 0.5), "z").when(F.col("b") < 0.4, "y").otherwise("x"))


def test_rows_do_not_meet_by_class(spark):
    # one class in nine of ten rows: beside a table too large to be broadcast by its size
    df = rows_of_classes(spark, 1_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ml.balanced_weights(df, "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("fan_in", [256, 2])
def test_forest_finds_regions(spark, monkeypatch, tmp_path, fan_in):
    monkeypatch.setattr(forest, "FAN_IN", fan_in)
    df = rows_of_classes(spark, 4_000)
    fitted = ml.fit_class_forest(df, ["a", "b", "c"], "k", ["x", "y", "z"], depth=5, trees=12)
    assert fitted.model.getNumTrees == 12 and max(t.depth for t in fitted.model.trees) <= 5
    named = F.element_at(F.array(*[F.lit(k) for k in "xyz"]), F.col("p").cast("int") + 1)
    assert fitted.predict(df, "p").agg(F.avg((named == F.col("k")).cast("int"))).first()[0] > 0.95
    names = [n for n, _ in ml.forest_importances(fitted)]
    assert names[-1] == "c"
    ml.save(fitted, str(tmp_path / "forest"))
    again = ml.load(str(tmp_path / "forest"))
    assert again.predict(df, "p").exceptAll(fitted.predict(df, "p")).isEmpty()


def test_best_split_equals_a_search():
    rng = np.random.default_rng(5)
    counts, weights, leaf = rng.integers(0, 4, (2, 3, 6, 3)).astype(float), np.array([1.0, 0.5, 3.0]), 2
    counts[1] = rng.permuted(counts[0], axis=1)
    total, which, cut, gain, left = forest.best_splits(counts, weights, leaf)
    gini = lambda v: 1 - ((v / v.sum()) ** 2).sum()
    for node in range(3):
        best = 0.0
        for f in range(2):
            for b in range(5):
                a, z = counts[f, node, : b + 1].sum(axis=0), counts[f, node, b + 1 :].sum(axis=0)
                if min(a.sum(), z.sum()) >= leaf:
                    wa, wz = a * weights, z * weights
                    w = wa.sum() + wz.sum()
                    best = max(best, gini(wa + wz) - wa.sum() / w * gini(wa) - wz.sum() / w * gini(wz))
        assert gain[node] == pytest.approx(best)
        assert (left[node] == counts[which[node], node, : cut[node] + 1].sum(axis=0)).all()
        assert (total[node] == counts[0, node].sum(axis=0)).all()


def test_cuts_part_evenly_and_between_values():
    assert forest._cuts([np.array([1.0, 2.0, 2.0, 4.0])], [1.0]).tolist() == [1.5, 3.0]
    cuts = forest._cuts([np.arange(1_000.0), np.arange(1_000.0)], [1.0, 1.0])
    assert len(cuts) == forest.BINS - 1 and (np.diff(cuts) > 30).all() and (np.diff(cuts) < 33).all()
    assert len(forest._cuts([np.full(9, 3.0)], [1.0])) == 0


def test_medians_of_many_rows(spark, monkeypatch):
    df = rows_of_classes(spark, 501).withColumn("b", F.when(F.col("b") > 0.2, F.col("b")))
    few = ml.prepare(df, ["a", "b"])
    monkeypatch.setattr(ml, "MEDIAN_ROWS", 100)
    many = ml.prepare(df, ["a", "b"])
    assert many.medians == pytest.approx(few.medians) and many.flagged == few.flagged == ["b"]
