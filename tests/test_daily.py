import datetime as dt

from pyspark.sql import functions as F

from millrace.functions import numbers, times
from millrace.operators import compare, daily, quality


def test_readable_times(spark):
    texts = ["2024-01-01T05:00:00+05:00", "2024-01-01 00:00:00Z", "2023-12-31 19:00:00-0500", " 2024-01-01T00:00:00+00:00 "]
    bad = ["2024-01-01 00:00:00", "0000-00-00 00:00:00", "2024-02-30T00:00:00Z", "n/a", "", None, "31/04 07h"]
    df = spark.createDataFrame([(t,) for t in texts + bad], "t string")
    got = [r[0] for r in df.select(F.unix_seconds(times.readable_time("t"))).collect()]
    assert got == [1704067200] * 4 + [None] * 7


def test_gate_counts_distinct_hours(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h, m), float(h)) for h in range(18) for m in (0, 30)] + [("a", dt.datetime(2024, 1, 2, h), 1.0) for h in range(17)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = {str(r["local_date"]): r for r in daily.gated_daily_means(df, ["k"], F.col("ts"), "v", F.to_date("ts")).collect()}
    assert (got["2024-01-01"]["n_hours"], got["2024-01-01"]["valid_day"], got["2024-01-01"]["value"]) == (18, True, 8.5)
    assert (got["2024-01-02"]["n_hours"], got["2024-01-02"]["valid_day"], got["2024-01-02"]["value"], got["2024-01-02"]["mean_value"]) == (17, False, None, 1.0)


def test_audit_counts_each_row_once(spark):
    t = "2024-01-0{}T00:00:00Z"
    rows = [
        ("p", 1, t.format(1), 5.0, 0.005), ("p", 1, t.format(1), 5.0, 0.005), ("p", 2, t.format(2), 5.0, 0.006), ("p", 3, None, 5.0, 0.005),
        ("p", 4, t.format(3), -1.0, -0.001), ("p", 5, t.format(4), float("nan"), 1.0), ("p", 6, t.format(9), 5.0, 0.005), ("p", 7, t.format(5), None, None),
    ]
    df = spark.createDataFrame(rows, "parameter string, id long, text string, v double, raw double")
    got = daily.cleaning_audit(df, "parameter", ["id"], times.readable_time("text"), "v", "raw", 1000.0, "2024-01-01", "2024-01-05").first()
    assert tuple(got)[1:] == (8, 8, 4, 1, 1, 1, 1, 0)  # raw, selected, invalid, unit, duplicate, retained, station-days, valid ones
    some = daily.cleaning_audit(df, "parameter", ["id"], times.readable_time("text"), "v", "raw", 1000.0, "2024-01-01", "2024-01-05", F.col("id") > 2).first()
    assert tuple(some)[1:] == (8, 5, 4, 0, 0, 0, 0, 0)


def test_close_clamp_season_cyclic(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-9), (1.0, 1.1), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.is_close(F.col("a"), F.col("b"))).collect()] == [True, False, None]
    assert [r[0] for r in df.select(numbers.not_below_zero(F.col("a") - 2)).collect()] == [0.0, 0.0, None]
    day = spark.createDataFrame([(dt.date(2024, 1, 1),), (None,)], "d date")
    assert [r[0] for r in day.select(numbers.season(F.col("d"))).collect()] == ["winter", None]
    assert day.select(numbers.cyclic_calendar(F.col("d"))["cos_week"]).first()[0] == 1.0  # a Monday


def test_histogram_edges_funnel_and_nulls(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1.1,), (None,)], "x double")
    assert {r["bin"]: r["n"] for r in compare.histogram(df, "x", 0, 1, 2).collect()} == {1: 1, 2: 2}
    steps = compare.funnel(df, [("all", F.lit(True)), ("low", F.col("x") < 1)], "x").orderBy("step").collect()
    assert [(r["n_rows"], r["n_distinct"]) for r in steps] == [(5, 4), (2, 2)]
    assert tuple(compare.null_profile(df).first()) == ("x", 5, 1)


def test_expectations_have_three_states(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "g long, s string")
    checks = quality.together(
        [
            quality.unique_key(df, ["g"], "unique"),
            quality.no_nulls(df, ["g"], "filled"),
            quality.group_in_one_split(df, "g", "s", "one split"),
            quality.holds(df.limit(0), F.lit(True), "nothing"),
            quality.row_count(df, 3, "rows"),
        ]
    )
    assert {r["name"]: r["status"] for r in checks.collect()} == {"unique": "FAIL", "filled": "PASS", "one split": "FAIL", "nothing": "NOT_VERIFIABLE", "rows": "PASS"}
    order = spark.createDataFrame([(dt.date(2020, 1, 1), "train"), (dt.date(2021, 1, 1), "test")], "d date, split string")
    assert quality.splits_in_order(order, "d", "split", ["train", "test"], 1, "order").first()["status"] == "PASS"
    assert quality.splits_in_order(order, "d", "split", ["test", "train"], 1, "order").first()["status"] == "FAIL"
    assert quality.fingerprint(df, ["g", "s"]).first() == quality.fingerprint(df.orderBy("s"), ["g", "s"]).first()
