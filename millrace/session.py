"""Session settings that the operators are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: AQE splits hot shuffle partitions of joins whose other side has unique keys;
#: groupings are pre-aggregated or cut into blocks by the operators themselves.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "millrace", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used as it is."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=SETTINGS)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    builder = builder.config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    # the driver serves the archive to the executors; only the driver reads this folder
    archive = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(home.rglob("*.py")):
            out.write(p, Path("millrace") / p.relative_to(home))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
