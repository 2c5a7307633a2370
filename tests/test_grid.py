import datetime as dt

import pytest

from millrace.operators import grid

READINGS = "reading_id long, datetime_utc string, station_id string, parameter string, value_ugm3 double"
STATIONS = "station_id string, parameter string, active_from timestamp, active_to timestamp"


def at(hour):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour)


BASE = int(at(0).timestamp()) // 3600


def text(hour, minute=5):
    return (at(hour) + dt.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%S+00:00")


def frames(spark, readings, stations):
    return spark.createDataFrame(readings, READINGS), spark.createDataFrame(stations, STATIONS)


def test_filled_carried_and_missing(spark):
    readings = [(1, text(0), "a", "co", 2.0), (2, text(0, 40), "a", "co", 4.0), (3, text(6), "a", "co", 9.0), (4, text(7), "a", "co", -1.0), (5, text(30), "a", "co", 1.0)]
    r, s = frames(spark, readings, [("a", "co", at(0), at(10))])
    got = {x["hour_epoch"] - BASE: (x["value"], x["n_readings"], x["status"]) for x in grid.regular_grid(r, s, 2).collect()}
    assert got[0] == (3.0, 2, "observed")
    assert got[1] == (3.0, 0, "carried")
    assert got[2] == (3.0, 0, "carried")
    assert got[3] == (None, 0, "missing")
    assert got[6] == (9.0, 1, "observed")
    assert got[7] == (9.0, 0, "carried")
    assert got[9] == (None, 0, "missing")
    assert sorted(got) == list(range(10))


def test_carry_across_blocks_matches_one_block(spark, monkeypatch):
    readings = [(i, text(h), "a", "co", float(h)) for i, h in enumerate([1, 5, 9, 14, 15, 22])]
    r, s = frames(spark, readings, [("a", "co", at(0), at(26))])
    whole = sorted(grid.regular_grid(r, s, 3).collect())
    monkeypatch.setattr(grid, "BLOCK_HOURS", 5)
    assert sorted(grid.regular_grid(r, s, 3).collect()) == whole


def test_nothing_is_carried_into_a_period(spark):
    r, s = frames(spark, [(1, text(4), "a", "co", 1.0)], [("a", "co", at(0), at(3)), ("a", "co", at(5), at(7))])
    assert {x["status"] for x in grid.regular_grid(r, s, 6).collect()} == {"missing"}


def test_overlaps_nulls_unknown_posts_and_repeats(spark):
    readings = [(1, text(1), "a", "co", 1.0), (1, text(1).replace("T", " "), "a", "co", 1.0), (2, None, "a", "co", 1.0), (3, text(2), "a", "co", None), (4, text(2), "a", "co", float("nan"))]
    readings += [(5, text(2), "zz", "co", 1.0), (6, text(2), None, None, 1.0), (7, "2024-01-01 08:30:00+0500", "a", "co", 0.0)]
    stations = [("a", "co", at(0), at(3)), ("a", "co", at(2), at(5)), ("a", "co", at(9), at(9)), (None, "co", at(0), at(2)), ("b", "co", None, at(2))]
    r, s = frames(spark, readings, stations)
    got = sorted(x["hour_epoch"] - BASE for x in grid.empty_hours(r, s).collect())
    assert got == [0, 2, 4]
    observed = {x["hour_epoch"] - BASE: x["n_readings"] for x in grid.regular_grid(r, s).filter("status = 'observed'").collect()}
    assert observed == {1: 1, 3: 1}


def test_empty_tables_and_clashing_columns(spark):
    r, s = frames(spark, [], [("a", "co", at(0), at(3))])
    assert grid.empty_hours(r, s).count() == 3
    assert grid.empty_hours(r, s.limit(0)).count() == 0
    clash = r.selectExpr("*", "1 AS h", "2 AS block", "3 AS n", "4 AS mean")
    assert grid.regular_grid(clash, s.selectExpr("*", "1 AS lo", "2 AS hi", "3 AS seen"), 4).count() == 3


def test_hours_per_local_day(spark):
    r, s = frames(spark, [(1, text(18), "a", "co", 1.0), (2, text(19), "a", "co", 1.0)], [("a", "co", at(0), at(24))])
    got = {str(x["local_date"]): x["n_hours"] for x in grid.hours_per_day(r, s).collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 1}


def test_gap_bound(spark):
    r, s = frames(spark, [], [])
    with pytest.raises(ValueError):
        grid.regular_grid(r, s, grid.BLOCK_HOURS)
