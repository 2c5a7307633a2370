"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

A written table cuts the lineage, survives lost executors and gives Catalyst true sizes
for what follows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, in local mode only, a new temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    sc.setCheckpointDir(folder)
    delete_at_exit(spark, folder)
    return folder


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.deleteOnExit(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that goes when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    return folder


class Written:
    """A written table: its frame, its folder and what was observed while writing."""

    def __init__(self, spark: SparkSession, folder: str, schema, seen: dict):
        self.spark, self.folder, self.seen = spark, folder, seen
        self.df = spark.read.schema(schema).parquet(folder)

    def drop(self) -> None:
        """Remove the files; only for tables that no lazy plan reads any more."""
        path, fs = _path(self.spark, self.folder)
        fs.delete(path, True)


def write_cut(df: DataFrame, name: str, **observed) -> Written:
    """Write df to the shared folder. observed: aggregate columns taken in the same pass."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    seen = None
    if observed:
        seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        out = df.observe(seen, *[F.expr(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in observed.items()])
    else:
        out = df
    out.write.parquet(folder)
    delete_at_exit(spark, folder)
    return Written(spark, folder, df.schema, seen.get if seen else {})
