import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import profile

SCHEMA = "load_no long, name string, code string, day date, x double, n int, ok boolean, received_at timestamp"


def load(no, size=600, **change):
    r = random.Random(no)
    rows = []
    for _ in range(size):
        row = {
            "name": r.choice(["Atyrau", "Aktau", "Aktobe", None]),
            "code": r.choice(["0110", "110", "kgmt_7"]),
            "day": dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(700)),
            "x": r.choice([None] + [round(r.lognormvariate(3, 1), 3)] * 20),
            "n": r.randrange(25),
            "ok": r.random() < 0.9,
        }
        row |= {k: f(row[k], r) for k, f in change.items()}
        rows.append((no, *row.values(), None))
    return rows


def changed(spark, rows):
    return {tuple(x) for x in profile.changed_columns(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_every_kind_of_change_is_found_and_nothing_else(spark):
    rows = [x for no in range(1, 9) for x in load(no)]
    rows += load(9, x=lambda v, r: None if r.random() < 0.4 else v)
    rows += load(10, x=lambda v, r: v and v / 1000)
    rows += load(11, code=lambda v, r: v.lstrip("0"))
    rows += load(12, day=lambda v, r: dt.date(1970, 1, 1) if r.random() < 0.3 else v)
    rows += load(13, ok=lambda v, r: not v)
    rows += load(14, x=lambda v, r: 25.0 if v and r.random() < 0.4 else v)
    rows += load(15, n=lambda v, r: v * 60)
    rows += load(16, x=lambda v, r: float("nan") if r.random() < 0.3 else v)
    rows += load(17, 40)
    assert changed(spark, rows) == {(9, "x"), (10, "x"), (11, "code"), (12, "day"), (13, "ok"), (14, "x"), (15, "n"), (16, "x")}


def test_rates_ranges_and_distinct_values_against_their_spread(spark):
    size = 3000
    rows = [x for no in range(1, 10) for x in load(no, size)]
    rows += load(10, size, x=lambda v, r: 1e9 if v and r.random() < 0.02 else v)
    rows += load(11, size, x=lambda v, r: None if r.random() < 0.055 else v)
    rows += load(12, size, code=lambda v, r: "0110?" if r.random() < 0.02 else v)
    rows += load(13, size, x=lambda v, r: float("nan") if r.random() < 0.02 else v)
    rows += load(14, size, day=lambda v, r: v - dt.timedelta(days=v.toordinal() % 4))
    rows += load(15, 100) + load(16, 12_000)
    assert changed(spark, rows) == {(10, "x"), (11, "x"), (12, "code"), (13, "x"), (14, "day")}


def test_null_loads_empty_tables_null_columns_and_names(spark):
    df = spark.createDataFrame([(None, *r[1:]) for r in load(1, 5)], SCHEMA)
    assert profile.column_profile(df).count() == 0
    assert profile.column_profile(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, "x" * 100_000), (1, None, ""), (2, None, None)], "load_no long, load string, `a b` string")
    odd = odd.withColumns({"token": F.lit("t"), "aspect": F.lit(1.5), "s": F.lit(None).cast("double")})
    got = {(r["load_no"], r["column_name"]): r for r in profile.column_profile(odd).collect()}
    assert len(got) == 10
    assert got[1, "load"]["null_rate"] == 1.0
    assert got[2, "a b"]["null_rate"] == 1.0
    assert not any(r["changed"] and r["n_rows"] < 3 and r["column_name"] == "token" for r in got.values())


def test_rare_masks_are_reported_as_rows(spark):
    rows = [x for no in range(1, 6) for x in load(no)]
    rows += load(6, code=lambda v, r: "0110?" if r.random() < 0.02 else v)
    got = {(r["load_no"], r["column_name"], r["mask"]): r for r in profile.rare_masks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[6, "code", "o999?"]["usual_share"] == 0.0
    assert got[6, "code", "o999?"]["n"] == sum(x[2] == "0110?" for x in rows)
    assert not any(c == "code" and m != "o999?" for _, c, m in got)
    assert profile.rare_masks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_counted_by_mask_and_hash(spark, monkeypatch):
    rows = [x for no in range(1, 5) for x in load(no)]
    df = spark.createDataFrame(rows, SCHEMA)
    columns = ["load_no", "column_name", "n_distinct", "top_mask", "min_value", "max_value", "mask_divergence", "value_divergence"]
    rows_of = lambda: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in profile.column_profile(df).select(columns).collect()]
    short = set(rows_of())
    monkeypatch.setattr(profile, "LONG_TEXT", 2)
    assert set(rows_of()) == short


@pytest.mark.parametrize(
    ("text", "mask"), [("kgmt_110", "a_999"), ("0110", "o999"), ("Atyrau", "Aa"), ("Атырау 7", "w 9"), ("", ""), ("2020-01-31", "9999-o9-99"), ("123456", "99999")]
)
def test_text_mask(spark, text, mask):
    assert spark.range(1).select(profile.text_mask(F.lit(text))).first()[0] == mask


@pytest.mark.parametrize(("number", "mask"), [(1.5, "9.9"), (-3.0, "-9."), (0.123456, "9.9999"), (1e300, "9E9")])
def test_number_mask(spark, number, mask):
    assert spark.range(1).select(profile._mask_name(profile.number_mask(F.lit(number)))).first()[0] == mask
