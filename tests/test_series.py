import datetime as dt
import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators import joins, quality, series

DAY = dt.date(2020, 1, 1)
SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame([(s, DAY + dt.timedelta(days=d), v) for s, d, v in rows], "s string, d date, v double")


def to_pandas(df):
    out = df.toPandas()
    out["d"] = pd.to_datetime(out["d"])
    return out.sort_values(["s", "d"]).reset_index(drop=True)


days = st.lists(st.tuples(st.integers(0, 60), st.one_of(st.none(), st.floats(-100, 100))), min_size=1, max_size=40, unique_by=lambda x: x[0])


@SLOW
@given(days)
def test_dense_lags_and_rolling_match_pandas(spark, rows):
    df = series.densify(frame(spark, [("a", d, v) for d, v in rows]), ["s"], "d")
    df = series.rolling(series.lags(df, ["s"], "d", "v", [1, 7]), ["s"], "d", "v", {3: 2, 7: 3}, {7: 3})
    got = to_pandas(df)
    s = pd.Series({pd.Timestamp(DAY) + pd.Timedelta(days=d): v for d, v in rows}, dtype=float).sort_index()
    s = s.reindex(pd.date_range(s.index.min(), s.index.max()))
    past = s.shift(1)
    want = {"v": s, "lag1": past, "lag7": s.shift(7), "rolling_mean3": past.rolling(3, 2).mean(), "rolling_mean7": past.rolling(7, 3).mean(), "rolling_std7": past.rolling(7, 3).std()}
    for name, w in want.items():
        pd.testing.assert_series_equal(got[name].astype(float), w.reset_index(drop=True), check_names=False, atol=1e-6)


@SLOW
@given(days)
def test_windows_agree_with_range_join(spark, rows):
    base = series.densify(frame(spark, [("a", d, v) for d, v in rows]), ["s"], "d")
    w = series.rolling(base, ["s"], "d", "v", {5: 1}, {}).select("s", "d", "rolling_mean5")
    r = joins.range_lookup(base, ["s"], "d", "v", 5).selectExpr("s", "d", "range_mean AS rolling_mean5")
    assert quality.frames_agree(w, r, ["s", "d"], ["rolling_mean5"], 1e-9, "same").first()["status"] == "PASS"


def test_islands_never_cross_a_gap(spark):
    rows = [("a", d, float(d)) for d in [0, 1, 2, 3, 4, 5, 6, 7, 10, 11]]
    got = to_pandas(series.island_features(frame(spark, rows), ["s"], "d", "v"))
    assert got["deviation_mean7"].notna().tolist() == [False] * 7 + [True] + [False] * 2
    assert got["deviation_mean7"].iloc[7] == pytest.approx(6 - 3)
    assert got["mean_change7"].iloc[7] == pytest.approx(1.0)
    assert pd.isna(got["value_lag1"].iloc[8])
    delta = to_pandas(series.continuity_diff(frame(spark, rows), ["s"], "d", "v"))["delta"]
    assert delta.isna().tolist() == [True] + [False] * 7 + [True, False]


def test_exact_offset_and_one_to_one(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("a", 3, 4.0), ("b", 1, 9.0)])
    got = {(r["s"], r["d"]): r["offset1"] for r in joins.exact_offset(df, ["s"], "d", "v", [1]).collect()}
    assert got[("a", DAY + dt.timedelta(days=1))] == 1.0
    assert got[("a", DAY + dt.timedelta(days=3))] is None
    assert joins.one_to_one(df, df.withColumnRenamed("v", "w"), ["s", "d"]).count() == 4
    with pytest.raises(Exception, match="key repeats"):
        joins.one_to_one(df, df.union(df).withColumnRenamed("v", "w"), ["s", "d"]).collect()


def test_near_hashes_match_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    rows = []
    for i in range(150):
        h = base[i % 30]
        for _ in range(r.randrange(0, 8)):
            h ^= 1 << r.randrange(64)
        rows.append((i, h - (1 << 64) if h >> 63 else h))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (None, 5)]
    got = {(x["a"], x["b"]): x["distance"] for x in joins.near_hashes(spark.createDataFrame(rows, "k long, h long"), "k", "h").collect()}
    heads = {}
    for k, h in rows:
        if k is not None and h is not None:
            heads[h] = min(heads.get(h, k), k)
    want = {}
    hs = list(heads.items())
    for n, (h, a) in enumerate(hs):
        for g, b in hs[n + 1 :]:
            if (x := ((h ^ g) & (2**64 - 1)).bit_count()) <= 6:
                want[min(a, b), max(a, b)] = x
    want |= {(heads[h], k): 0 for k, h in rows if k is not None and h is not None and heads[h] != k}
    assert got == want


def test_linked_groups(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["member"]: r["group_id"] for r in joins.smallest_linked(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
