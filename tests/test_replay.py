import datetime as dt

import pytest

from millrace.streaming import replay

SCHEMA = "series string, seq long, date string, level string"


def base(n=24):
    return [["s", i, (dt.date(2022, 1, 1) + dt.timedelta(days=i)).isoformat(), str(200 + i)] for i in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    return [r.asDict() for r in replay.replay_batch(df, 31.0, **kw).orderBy("series", "seq").collect()]


def forecast_rows(out):
    return [r["seq"] for r in out if r["prediction"] is not None]


def test_plain_run_forecasts_from_the_seventh_day(spark):
    out = run(spark, base())
    assert forecast_rows(out) == list(range(6, 24))
    assert {r["quality"] for r in out} == {"valid"}
    assert out[10]["prediction"] == 210.0
    assert run(spark, base(), model="drift")[10]["prediction"] == 211.0


def test_gap(spark):
    rows = base()
    del rows[8]
    out = run(spark, rows)
    assert out[8]["quality"] == "date_gap"
    assert out[8]["proposed_action"] == "check_missing_or_invalid_record"
    assert [r["observation_date"].isoformat() for r in out if r["prediction"] is not None][2] == "2022-01-16"


def test_missing_value(spark):
    rows = base()
    rows[8][3] = "NaN"
    out = run(spark, rows)
    assert out[8]["quality"] == "missing_or_invalid"
    assert forecast_rows(out) == [6, 7, *range(15, 24)]
    assert not out[8]["statistical_flag"]
    assert not out[9]["statistical_flag"]


def test_malformed(spark):
    rows = base()
    rows[8][3], rows[18][2] = "bad-value", "bad-date"
    out = run(spark, rows)
    assert out[8]["quality"] == "missing_or_invalid"
    assert out[18]["quality"] == "invalid_date"
    assert out[19]["quality"] == "date_gap"
    assert forecast_rows(out) == [6, 7, 15, 16, 17]


def test_threshold_is_strict(spark):
    rows = base(3)
    rows[1][3] = "231"
    assert not run(spark, rows)[1]["statistical_flag"]
    rows[1][3] = "231.5"
    assert run(spark, rows)[1]["proposed_action"] == "check_measurement_and_context_manually"


@pytest.mark.parametrize("model", ["persistence", "drift"])
def test_stream_gives_the_same_rows(spark, tmp_path, model):
    rows = base() + [["t", i, r[2], r[3]] for i, r in enumerate(base(20))]
    rows[8][3], rows[18][2], rows[30][3] = "bad", "x", None
    rows[40][3] = "900"
    (tmp_path / "in").mkdir()
    frame = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    for part, condition in enumerate(["seq < 9", "seq >= 9"]):  # two micro-batches
        frame.filter(condition).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay.replay_stream(stream, 31.0, model).writeStream.format("memory").queryName(f"replayed_{model}").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    batch = replay.replay_batch(frame, 31.0, model)
    got = replay.parity(batch, spark.table(f"replayed_{model}")).first()
    assert (got["n_rows"], got["differences"]) == (len(rows), 0)


def test_a_fitted_model_and_an_unknown_one(spark, tmp_path):
    from millrace.operators import ml
    from millrace.streaming.replay import past_features

    days = spark.createDataFrame([("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), 200.0 + i + (i * 7) % 5) for i in range(120)], "series string, day date, total double")
    from millrace.functions import numbers
    from millrace.operators import series as s
    from pyspark.sql import functions as F

    names = list(past_features(F.lit(None).cast("array<double>"), F.current_date()))
    frame = s.island_features(days, ["series"], "day", "total").withColumns(numbers.cyclic_calendar(F.col("day"))).dropna(subset=["deviation_mean7", "mean_change7", "delta_lag3"])
    fitted = ml.fit_ridge(frame, names, "delta_target", 1.0)
    rows = [tuple(r) for r in base()]
    frame = spark.createDataFrame(rows, SCHEMA)
    batch = replay.replay_batch(frame, 31.0, fitted)
    assert forecast_rows([r.asDict() for r in batch.orderBy("seq").collect()]) == list(range(6, 24))
    got = replay.parity(batch, replay.replay_files(frame, 31.0, fitted, 3)).first()
    assert (got["n_rows"], got["differences"]) == (24, 0)
    assert {r["prediction"] for r in batch.collect()} != {r["prediction"] for r in replay.replay_batch(frame, 31.0).collect()}
    for run_ in (replay.replay_batch, replay.replay_files):
        with pytest.raises(ValueError):
            run_(frame, 31.0, "persistense")


def test_daily_stream(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, d, h), float(d)) for d in range(1, 8) for h in (1, 5)]
    spark.createDataFrame(rows, "k string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = replay.daily_stream(stream, "ts", ["k"], "v", "1 day").writeStream.format("memory").queryName("days").outputMode("complete")
    q = q.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert {(r["mean_value"], r["n"]) for r in spark.table("days").collect()} == {(float(d), 2) for d in range(1, 8)}
