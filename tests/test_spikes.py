import datetime as dt

import numpy as np
import pytest

from millrace.operators import spikes

HOUR = 3600


def series(values, station="0110", parameter="pm10", first=0, start=1_600_000_000):
    return [
        (first + i, dt.datetime.fromtimestamp(start + i * HOUR, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), station, parameter, None if v is None else float(v))
        for i, v in enumerate(values)
    ]


SCHEMA = "reading_id long, datetime_utc string, station_id string, parameter string, value_ugm3 double"


def walk(n=300, seed=0, level=50.0, step=0.04):
    return level * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, step, n)) * 0.3)


def found(spark, rows, schema=SCHEMA):
    return {r["reading_id"]: r["kind"] for r in spikes.implausible_readings(spark.createDataFrame(rows, schema)).collect()}


def test_spikes_up_and_down_and_of_three_readings(spark):
    v = walk()
    v[50] *= 6
    v[120] /= 5
    v[200:203] *= 5
    assert found(spark, series(v)) == {i: "spike" for i in (50, 120, 200, 201, 202)}


def test_four_readings_and_a_new_level_are_no_spikes(spark):
    v = walk()
    v[100:104] *= 6
    v[200:] *= 8
    assert found(spark, series(v)) == {}


def test_slow_episode_is_no_spike(spark):
    v = walk() * (1 + 9 * np.exp(-(((np.arange(300) - 150) / 20) ** 2)))
    assert found(spark, series(v)) == {}


def test_stuck_run_against_ordinary_repeats(spark):
    v = np.round(walk(seed=3), 1)
    v[80:92], v[92] = v[80], v[80] + 1
    coarse = np.round(walk(800, seed=4) / 10) * 10
    got = found(spark, series(v) + series(coarse, "110", first=10_000))
    assert got == {i: "stuck" for i in range(80, 92)}


def test_negative_nulls_repeats_and_bad_times(spark):
    v = list(walk(40))
    v[5], v[6], v[7] = -1.0, None, float("nan")
    rows = series(v)
    rows += [(900, None, "0110", "pm10", -2.0), (901, "31/04 07h", None, None, 10.0), (902, "", "0110", "pm10", 1e9), (None, None, None, None, None)]
    rows += rows[:20] + [(0, "2020-09-13 17:26:40+05:00", "0110", "pm10", float(v[0]))]
    assert found(spark, rows) == {5: "negative", 900: "negative"}


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == {}
    rows = [(*r, 1, 2.0, "x") for r in series(walk(60))]
    assert found(spark, rows, SCHEMA + ", chunk int, v double, day string") == {}


def test_chunks_agree_with_the_whole(spark, monkeypatch):
    v = walk(3000, seed=5)
    v[[500, 1499, 1500, 2400]] *= 6
    v[995:1015] = v[995]
    whole = found(spark, series(v))
    monkeypatch.setattr(spikes, "CHUNK", 500)
    monkeypatch.setattr(spikes, "HALO", 100)
    assert found(spark, series(v)) == whole
    assert set(whole) == {500, 1499, 1500, 2400, *range(995, 1015)}


def test_a_freeze_does_not_excuse_itself_and_may_cover_chunks(spark, monkeypatch):
    short = [5.0, 6.0, 5.5, 6.5, 5.0, 6.0, 5.5, 6.5] + [7.0] * 40
    long = list(walk(150, seed=6)) + [60.0] * 1500 + list(walk(150, seed=7))
    monkeypatch.setattr(spikes, "CHUNK", 500)
    monkeypatch.setattr(spikes, "HALO", 100)
    got = found(spark, series(short) + series(long, "110", first=10_000))
    assert got == {i: "stuck" for i in [*range(8, 48), *range(10_150, 11_650)]}


def test_the_ellipsoid_decides(spark, monkeypatch):
    """Excursions that a noisy series shows all the time pass the bound, but do not leave the ellipsoid."""
    noisy = 50 * np.exp(np.random.default_rng(1).normal(0, 0.7, 3000))
    noisy[[700, 1900]] = 50 * np.exp([6.0, -6.0])
    got = spikes.spike_mask(noisy)
    assert got[[700, 1900]].all() and got.sum() < 20
    monkeypatch.setattr(spikes, "phase_space_outliers", lambda x, usual=None: (np.ones(len(x), bool), None))
    assert spikes.spike_mask(noisy).sum() > 400


def test_the_usual_step_is_that_of_the_series(spark, monkeypatch):
    """A calm chunk of a noisy series is judged by the series."""
    rng = np.random.default_rng(2)
    v = 50 * np.exp(np.r_[rng.normal(0, 0.6, 1000), rng.normal(0, 0.02, 300), rng.normal(0, 0.6, 700)])
    v[1150] *= np.exp(1.3)
    assert spikes.spike_mask(v[1000:1300])[150]
    monkeypatch.setattr(spikes, "CHUNK", 250)
    monkeypatch.setattr(spikes, "HALO", 20)
    assert 1150 not in found(spark, series(v))


def test_planted_spikes_of_many_series(spark):
    """Recall and precision at least 0.99 over 300 series with 3 spikes each."""
    rng, rows, planted = np.random.default_rng(3), [], set()
    for s in range(300):
        v = walk(200, seed=s)
        for at in (30, 90, 150):
            length, sign = int(rng.integers(1, 4)), rng.choice([-1, 1])
            v[at : at + length] *= np.exp(sign * rng.uniform(1.4, 3.0, length))
            planted |= {s * 1000 + i for i in range(at, at + length)}
        rows += series(v, str(s), first=s * 1000)
    got = set(found(spark, rows))
    assert len(got & planted) >= 0.99 * len(planted)
    assert len(got & planted) >= 0.99 * len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_short_series(n):
    v = np.full(n, 3.0)
    assert not spikes.spike_mask(v).any()
    assert not spikes.stuck_mask(v).any()


def test_pairs(spark):
    rows = [(1, 13.0, 10.0), (1, 13.0, 10.0), (2, 12.0, 10.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 1.0, float("nan")), (None, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "pair_id long, pm2_5 double, pm10 double")
    assert [r[0] for r in spikes.implausible_pairs(df).collect()] == [1]
    assert spikes.implausible_pairs(df.limit(0)).count() == 0
