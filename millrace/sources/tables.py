"""Scans: parquet tables by folder, with times as instants and NaN as null where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as it is stored; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many tasks as there are cores, for costly work on few files.

    Large tables already come in more splits than that and are left as they are.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= tasks else df.repartition(tasks)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, so that comparisons and averages skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def instants(df: DataFrame) -> DataFrame:
    """Timestamps without a zone are read as UTC instants (the session's zone is UTC)."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("timestamp") for c in plain}) if plain else df


def clean(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """table() with NaN as null and times as instants."""
    return instants(nan_to_null(table(spark, folder, name)))
