"""Published results, from the yearbook pages that MILLRACE_PAGES lists (text files whose names begin with the year, parted like PATH)."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators import compare, metrics, series
from millrace.sources import files
from millrace.streaming import replay

PAGES = [Path(p) for p in os.environ.get("MILLRACE_PAGES", "").split(os.pathsep) if p]
pytestmark = pytest.mark.skipif(not PAGES, reason="MILLRACE_PAGES is not set")


@pytest.fixture(scope="module")
def pages(spark):
    texts = [(int(p.name[:4]), p.read_text(encoding="utf-8")) for p in PAGES]
    return spark.createDataFrame(texts, "year int, text string")


@pytest.fixture(scope="module")
def levels(pages):
    return files.level_pages(pages)[0].select(F.lit("post").alias("series"), "date", "level_cm", "year").cache()


def test_levels_and_monthly_means(pages, levels):
    assert levels.count() == 1095
    assert files.page_problems(pages).count() == 0
    means = levels.groupBy("year", F.month("date").alias("month")).agg(F.avg("level_cm").alias("computed"))
    agree = compare.reconcile(means, files.level_pages(pages)[1], ["year", "month"], "computed", "published_mean", 0.51)
    assert agree.count() == agree.filter("agrees").count() == 36


def test_baselines_and_replay(levels):
    features = series.island_features(levels, ["series"], "date", "level_cm").dropna(subset=["deviation_mean7", "mean_change7", "delta_lag3"])
    assert features.count() == 1081
    test = features.filter("year = 2022").withColumns({"persistence": F.col("value_lag1"), "drift": F.col("value_lag1") + F.col("delta_lag1")})
    got = {r["model"]: (r["n"], round(r["mae"], 4)) for r in metrics.regression_metrics(metrics.long_predictions(test, [], "level_cm", ["persistence", "drift"]), ["model"]).collect()}
    assert got == {"persistence": (358, 6.9665), "drift": (358, 8.9106)}
    changes = series.continuity_diff(levels.filter("year < 2022"), ["series"], "date", "level_cm").select(F.abs("delta").alias("d"))
    threshold = compare.quantiles(changes, [], "d", {"q": 0.99}).first()["q"]
    assert threshold == 31.0
    seen = levels.filter("year = 2022").select("series", F.dayofyear("date").cast("long").alias("seq"), F.col("date").cast("string").alias("date"), F.col("level_cm").alias("level"))
    assert tuple(replay.summary(replay.replay_batch(seen, threshold)).first())[:3] == (365, 359, 8)
