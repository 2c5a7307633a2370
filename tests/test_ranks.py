import numpy as np
import pytest

from millrace.operators import ranks, stats


@pytest.mark.parametrize("size", [1, 500_000])
def test_quantiles_of_groups_with_ties_nulls_and_null_keys(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "RANGE_ROWS", size)
    rng = np.random.default_rng(1)
    rows = [(g, None if rng.random() < 0.1 else float(np.round(rng.lognormal(0, 2), 1))) for g in ("a", "b", None) for _ in range(400)] + [("c", None), ("d", 3.0)]
    got = {r[0]: r[1:] for r in ranks.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"m": 0.5, "p99": 0.99}).collect()}
    for g in ("a", "b", None, "d"):
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g] == pytest.approx(tuple(np.quantile(v, [0.5, 0.99])))
    assert got["c"] == (None, None)
    assert ranks.quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("size", [1, 500_000])
def test_spearman_with_and_without_nulls(spark, monkeypatch, size):
    def rank(v):
        v = np.asarray(v)
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    def rho(x, y):
        return np.corrcoef(rank(x), rank(y))[0, 1]

    monkeypatch.setattr(ranks, "RANGE_ROWS", size)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 20, 500).astype(float)
    b = a + rng.normal(0, 5, 500)
    c = [None if rng.random() < 0.2 else float(x) for x in np.round(-b + rng.normal(0, 3, 500))]
    rows = [(float(x), float(y), z, 7.0) for x, y, z in zip(a, b, c, strict=True)]
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in stats.spearman(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"]).collect()}
    kept = [k for k, z in enumerate(c) if z is not None]
    assert got["a", "b"] == (500, pytest.approx(rho(a, b)))
    assert got["a", "c"] == (len(kept), pytest.approx(rho(a[kept], [c[k] for k in kept])))
    assert got["c", "c"] == (len(kept), 1.0)
    assert got["a", "d"] == (500, None) and got["d", "d"] == (500, None)
