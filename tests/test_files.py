import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import compare
from millrace.sources import files, scratch, tables


def test_hourly_csv_takes_parameter_from_the_file(spark, tmp_path):
    head = "datetime_utc,station_id,station_name,city,lat,lon,value_ugm3,raw_value,raw_unit\n"
    for name, rows in (("pm10", "2024-01-01T00:00:00Z,0110,P,Atyrau,1,2,5.0,0.005,mg/m3\n"), ("co", "2024-01-01T00:00:00Z,110,,Aktau,1,2,,,\n")):
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(head + rows)
    got = {(r["parameter"], r["station_id"], r["value_ugm3"]) for r in files.read_hourly_csv(spark, str(tmp_path)).collect()}
    assert got == {("pm10", "0110", 5.0), ("co", "110", None)}
    assert files.read_hourly_csv(spark, str(tmp_path), ["Aktau"]).count() == 1


def test_columnar_json_and_annotations(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"daily": {"time": ["2024-01-01", "2024-01-02"], "t": [1.5, None]}}))
    got = files.read_columnar_json(spark, str(tmp_path / "w.json"), "daily", "time array<string>, t array<double>")
    assert [tuple(r) for r in got.orderBy("date").collect()] == [("2024-01-01", 1.5), ("2024-01-02", None)]
    doc = {
        "images": [{"id": 1, "license": 4, "width": 640, "height": 480, "file_name": "a.jpg", "flickr_url": "u"}, {"id": 2, "license": 9, "width": 1, "height": 1}],
        "licenses": [{"id": 4, "name": "by", "url": "l"}],
        "annotations": [
            {"id": 10, "image_id": 1, "category_id": 3, "iscrowd": 0, "bbox": [0.0, 0.0, 40.0, 41.0]},
            {"id": 11, "image_id": 1, "category_id": 3, "iscrowd": 1, "bbox": [0.0, 0.0, 90.0, 90.0]},
            {"id": 12, "image_id": 1, "category_id": 3, "iscrowd": 0, "bbox": [0.0, 0.0, 39.0, 90.0]},
            {"id": 13, "image_id": 2, "category_id": 3, "iscrowd": 0, "bbox": [0.0, 0.0, 90.0, 90.0]},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    parts = files.read_annotations(spark, str(tmp_path / "a.json"))
    assert {k: v.count() for k, v in parts.items()} == {"images": 2, "annotations": 4, "licenses": 1}
    assert [r["id"] for r in files.eligible(parts["annotations"], parts["images"], [4]).collect()] == [10]


def page(year, levels, broken=None):
    """A page: header of months, a line per day with marks, then the monthly means."""
    lines = ["Station 1.2.", "1 2 3 4 5 6 7 8 9 10 11 12"]
    for d in range(1, 32):
        cells = []
        for m in range(1, 13):
            try:
                dt.date(year, m, d)
            except ValueError:
                continue
            cells.append(f"{levels(m, d)}" + (" *" if (m, d) == (2, 3) else ""))
        lines.append(f"{d} " + " ".join(cells if d != broken else cells[1:]))
    lines.append("mean " + " ".join(str(300 + m) for m in range(1, 13)) + " 2.5")
    return "\r\n".join(lines)


def test_level_pages_and_reconciliation(spark):
    pages = spark.createDataFrame([(2019, page(2019, lambda m, d: 300 + m)), (2020, page(2020, lambda m, d: 400 + d, broken=7)), (2021, "no table"), (2022, None)], "year int, text string")
    levels, means = files.level_pages(pages)
    got = {(r["year"], r["date"]): (r["level_cm"], r["marks"]) for r in levels.collect()}
    assert sum(1 for y, _ in got if y == 2019) == 365
    assert sum(1 for y, _ in got if y == 2020) == 366 - 12
    assert got[2019, dt.date(2019, 2, 3)] == (302, "*")
    assert got[2020, dt.date(2020, 2, 29)][0] == 429
    monthly = levels.filter("year = 2019").groupBy("year", F.month("date").alias("month")).agg(F.avg("level_cm").alias("computed"))
    checks = compare.reconcile(monthly, means, ["year", "month"], "computed", "published_mean", 0.51).collect()
    assert len(checks) == 12
    assert all(r["agrees"] for r in checks)


def test_registers_with_other_names_and_marks(spark):
    a = spark.createDataFrame([("s1", "u1", "first"), ("s2", "u2", "x")], "source_id string, url string, title string")
    b = spark.createDataFrame([("s1", "u1", "second"), ("s3", "u3", None)], "`﻿ID` string, link string, name string")
    got = files.merge_registers([(a, {}), (b, {"source_id": "ID", "url": "link", "title": "name"})], ["source_id", "url"], ["source_id", "url", "title"])
    assert sorted(tuple(r) for r in got.collect()) == [("s1", "u1", "first"), ("s2", "u2", "x"), ("s3", "u3", None)]


def test_manifest_hashes_and_reports(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    row = files.manifest(spark, str(tmp_path)).first()
    assert (row["bytes"], row["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())
    df = spark.createDataFrame([(1234, 12.34, None)], "n long, share double, x double")
    assert files.markdown_table(df, {"n": "int", "share": "pct", "x": "dec3"}) == ["| n | share | x |", "|---|---|---|", "| 1,234 | 12.3 % | — |"]
    assert json.loads(files.report_json(df)) == {"n": 1234, "share": 12.34, "x": None}
    assert files.canonical_hash(df, ["x", "n"]).first()["row_sha256"] == files.canonical_hash(df, ["n", "x"]).first()["row_sha256"]


def test_scan_makes_nan_null_and_times_instants(spark):
    df = spark.createDataFrame([(1.0, dt.datetime(2024, 1, 1)), (float("nan"), None)], "v double, t timestamp_ntz")
    got = tables.instants(tables.nan_to_null(df))
    assert dict(got.dtypes) == {"v": "double", "t": "timestamp"}
    assert [r["v"] for r in got.collect()] == [1.0, None]


def test_written_tables_are_dropped_and_observed(spark):
    w = scratch.write_cut(spark.range(10), "t", n="count(*)", top="max(id)")
    assert w.seen == {"n": 10, "top": 9}
    assert w.df.count() == 10
    w.drop()
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(w.folder).count()


def test_page_problems(spark):
    pages = spark.createDataFrame([(2020, page(2020, lambda m, d: 400 + d, broken=7)), (2021, "no table"), (2022, None)], "year int, text string")
    got = {(r["year"], r["day_of_month"], r["problem"]) for r in files.page_problems(pages).collect()}
    assert got == {(2020, 7, "11 levels for 12 months"), (2021, None, "no table"), (2022, None, "no table")}


def test_csv_with_mark_gzip_and_labels(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_csv(df, str(tmp_path / "out"), single=True, gzip=True, mark=True)
    (part,) = (tmp_path / "out").glob("*.csv.gz")
    assert gzip.open(part).read().startswith(b"\xef\xbb\xbfk,v")
    lines = files.markdown_table(df, {}, {"k": "Number"}, {"v": {"a": "first"}})
    assert lines[0] == "| Number | v |"
    assert lines[2:] == ["| 1 | first |", "| 2 | — |"]


def test_protected_spans_and_prefixes(spark):
    from millrace.functions import text

    df = spark.createDataFrame([("post32 and `post32`  at [a](x32)  https://h/post32 post33",), (None,)], "t string")
    assert df.select(text.polish(F.col("t"))).first()[0] == "post 32 and `post32` at [a](x32) https://h/post32 post 33"
    assert [r[0] for r in df.select(text.has_prefix(F.col("t"), "post")).collect()] == [True, False]
