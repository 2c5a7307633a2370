"""Readers and writers: CSV archives, JSON documents, text tables, manifests, registers."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import spread

HOURLY = "datetime_utc string, station_id string, station_name string, city string, lat double, lon double, value_ugm3 double, raw_value double, raw_unit string"


def read_hourly_csv(spark: SparkSession, path: str, cities: list[str] | None = None) -> DataFrame:
    """Hourly archives, one file per parameter: the parameter is taken from the file's name.

    gzip files are read whole by one task each, so the rows left are spread before further work.
    """
    rows = spark.read.schema(HOURLY).option("header", True).csv(path)
    rows = rows.withColumn("parameter", F.regexp_extract(F.col("_metadata.file_name"), r"([a-z0-9_]+?)[.]csv", 1))
    return spread(rows.filter(F.col("city").isin(cities)) if cities else rows)


def read_columnar_json(spark: SparkSession, path: str, block: str, schema: str) -> DataFrame:
    """Rows from a document of parallel arrays: {block: {time: [...], a: [...]}}; time becomes date."""
    doc = spark.read.schema(f"{block} struct<{schema}>").option("multiLine", True).json(path)
    rows = doc.select(F.expr(f"inline(arrays_zip({', '.join(f'{block}.{c}' for c in doc.schema[block].dataType.names)}))"))
    return rows.withColumnRenamed("time", "date")


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three relations of an annotation document: images, annotations, licenses."""
    schema = (
        "images array<struct<id:long,license:int,file_name:string,width:int,height:int,coco_url:string,flickr_url:string,date_captured:string>>,"
        "licenses array<struct<id:int,name:string,url:string>>,"
        "annotations array<struct<id:long,image_id:long,category_id:int,iscrowd:int,bbox:array<double>>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return {name: doc.select(F.inline(name)) for name in ("images", "annotations", "licenses")}


def eligible(annotations: DataFrame, images: DataFrame, licenses: list[int], side: float = 40.0) -> DataFrame:
    """Annotations with an allowed licence, both sides of at least side, and no crowd."""
    box = (F.col("bbox")[2] >= side) & (F.col("bbox")[3] >= side) & (F.col("iscrowd") == 0)
    allowed = images.filter(F.col("license").isin(licenses)).select(F.col("id").alias("image_id"), "license", "width", "height", "flickr_url")
    return annotations.filter(box).join(allowed, "image_id")


def manifest(spark: SparkSession, path: str, recursive: bool = True, purposes: dict[str, str] | None = None) -> DataFrame:
    """(path, purpose, bytes, sha256) of files; contents are hashed where they are read.

    purposes: {regular expression of the path: purpose}, the first that matches; else null.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    purpose = F.lit(None).cast("string")
    for pattern, name in reversed(list((purposes or {}).items())):
        purpose = F.when(F.col("path").rlike(pattern), name).otherwise(purpose)
    return reader.load(path).select("path", purpose.alias("purpose"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def canonical_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of each row's JSON with sorted keys."""
    return df.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def merge_registers(parts: list[tuple[DataFrame, dict[str, str]]], keys: list[str], columns: list[str]) -> DataFrame:
    """One register from tables with drifting column names; the first part wins for equal keys.

    parts: (table, {standard name: its name there}); byte-order marks before names are dropped.
    """
    frames = []
    for rank, (df, names) in enumerate(parts):
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
        have = [F.col(f"`{names.get(c, c)}`").cast("string").alias(c) for c in columns if names.get(c, c) in df.columns]
        frames.append(df.select(*have).withColumn("_part", F.lit(rank)))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    rest = [c for c in columns if c not in keys]
    order = F.struct("_part", *[F.coalesce(F.col(c), F.lit("")) for c in rest])
    return merged.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def write_csv(df: DataFrame, path: str, single: bool = False, gzip: bool = False, mark: bool = False) -> None:
    """CSV with a header; single only for small reports. mark: each file begins with a byte-order mark, for spreadsheets."""
    if mark and df.columns:
        df = df.toDF("\ufeff" + df.columns[0], *df.columns[1:])
    writer = (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True)
    writer.option("compression", "gzip" if gzip else "none").csv(path)


def write_feature_table(df: DataFrame, path: str) -> None:
    """Feature vectors as parquet array<float>."""
    df.write.mode("overwrite").parquet(path)


def report_json(df: DataFrame) -> str:
    """A small result (one row) as JSON; NaN is not allowed."""
    row = df.limit(1).collect()
    return json.dumps(row[0].asDict(recursive=True) if row else {}, allow_nan=False, default=str, ensure_ascii=False)


def markdown_cell(x: Column, kind: str) -> Column:
    """A report cell: int, pct or dec3; null is an em dash."""
    text = {"int": F.format_number(x.cast("double"), 0), "pct": F.concat(F.format_number(x.cast("double"), 1), F.lit(" %")), "dec3": F.format_number(x.cast("double"), 3)}
    return F.coalesce(text.get(kind, x.cast("string")), F.lit("—"))


def markdown_table(df: DataFrame, kinds: dict[str, str], titles: dict[str, str] | None = None, labels: dict[str, dict[str, str]] | None = None) -> list[str]:
    """Lines of a markdown table of a small report, rows in the frame's order.

    titles: {column: heading}; labels: {column: {value: what is shown for it}}, other values as they are.
    """
    cells = []
    for c in df.columns:
        cell = markdown_cell(F.col(c), kinds.get(c, "text"))
        for value, label in (labels or {}).get(c, {}).items():
            cell = F.when(F.col(c).cast("string") == value, label).otherwise(cell)
        cells.append(cell)
    heads = [(titles or {}).get(c, c) for c in df.columns]
    lines = [r[0] for r in df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))).collect()]
    return ["| " + " | ".join(heads) + " |", "|" + "---|" * len(df.columns), *lines]


def level_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily levels and published monthly means from yearbook pages.

    pages: (year int, text string). After the line '1 2 ... 12' come 31 lines, one per day,
    with a three-digit level for every month that has the day, each followed by its marks;
    the next line has the twelve published means. In a line with another number of levels than
    months no level can be told its month: page_problems reports it, and it gives no rows.
    Returns (year, date, level_cm, marks) and (year, month, published_mean).
    """
    located, table = _page_lines(pages)
    fits = table.filter(F.size("months") == F.size("cells"))
    levels = fits.select("year", "d", F.expr("inline(arrays_zip(months, cells, marks))")).select(
        "year", F.make_date("year", "months", "d").alias("date"), F.col("cells").cast("int").alias("level_cm"), F.trim("marks").alias("marks")
    )
    mean_line = F.get("lines", F.col("head").cast("int") + 31)
    means = located.select("year", F.posexplode(F.regexp_extract_all(mean_line, F.lit(f"({_LEVEL})"), F.lit(1))).alias("m", "value"))
    return levels, means.select("year", (F.col("m") + 1).alias("month"), F.col("value").cast("int").alias("published_mean"))


def page_problems(pages: DataFrame) -> DataFrame:
    """What level_pages cannot read: (year, day_of_month, problem, line). A page without a table has one row without a day."""
    located, table = _page_lines(pages)
    lines = table.filter(F.size("months") != F.size("cells"))
    found = F.concat(F.size("cells").cast("string"), F.lit(" levels for "), F.size("months").cast("string"), F.lit(" months"))
    lines = lines.select("year", F.col("d").alias("day_of_month"), found.alias("problem"), "line")
    bare = pages.join(located.select("year").distinct(), "year", "left_anti")
    return lines.unionByName(bare.select("year", F.lit(None).cast("int").alias("day_of_month"), F.lit("no table").alias("problem"), F.lit(None).cast("string").alias("line")))


#: A level: three digits by themselves (format of the source).
_LEVEL = r"(?<![\d.])\d{3}(?![\d.])"


def _page_lines(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with their lines and the place of the table's head; the table's day lines with months, levels and marks)."""
    number = _LEVEL
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x))
    located = pages.select("year", lines.alias("lines")).withColumn("head", F.array_position("lines", F.lit("1 2 3 4 5 6 7 8 9 10 11 12")))
    located = located.filter(F.col("head") > 0)
    days = located.select("year", F.posexplode(F.slice("lines", F.col("head").cast("int") + 1, 31)).alias("d", "line")).withColumn("d", F.col("d") + 1)
    months = F.expr("filter(sequence(1, 12), m -> day(last_day(make_date(year, m, 1))) >= d)")
    cells = F.regexp_extract_all("line", F.lit(f"({number})"), F.lit(1))
    # what stands between a level and the next one are its marks
    marks = F.expr(rf"slice(split(line, '{number.replace(chr(92), chr(92) * 2)}'), 2, 100)")
    table = days.select("year", "d", "line", months.alias("months"), cells.alias("cells"), marks.alias("marks"))
    return located, table
