"""Spark session defaults and lineage cutting.

The settings below are the ones every job in the package relies on: AQE (runtime broadcast of small
per-cell tables, skew-join splitting of hot cells, partition coalescing), UTC session time, ANSI mode
left on. ``spark.checkpoint.dir`` is read from the session; a local default is set only when the
session has none (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "cyclelake") -> SparkSession:
    """Session for tests and local runs. On a cluster, pass the cluster's own session to the library instead."""
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and is_local(master):
        # Test-sized shuffles are a few MB, and the default 64 MB advisory size would let AQE coalesce them into
        # one task. Cluster sessions keep their own advisory size and driver memory.
        builder = builder.config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        builder = builder.config("spark.driver.memory", os.environ.get("CYCLELAKE_DRIVER_MEMORY", "16g"))
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if is_local(spark.sparkContext.master):
        checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Uses ``spark.checkpoint.dir`` when the session names one. On a local master a fresh scratch folder is created
    otherwise, and recorded in the session so that later calls agree; on a cluster that would put files where other
    executors can't see them, so an unset folder is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cyclelake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_MATERIALISED: dict[tuple[str, str], str] = {}


def written_once(spark: SparkSession, name: str, key: str, write: Callable[[str], None]) -> str:
    """Run ``write(path)`` once per (application, name, key) for a fresh path under the checkpoint folder and
    return the path; later calls return the same path without writing."""
    app = spark.sparkContext.applicationId
    cache_key = (app, f"{name}:{key}")
    path = _MATERIALISED.get(cache_key)
    if path is None:
        path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
        write(path)
        _MATERIALISED[cache_key] = path
    return path


def materialise(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per (application, name, key) as parquet under the checkpoint folder; read it back.

    This cuts lineage (an executor lost later re-reads files instead of re-running the derivation) and
    lets several queries share one derived table. ``build`` is only called the first time.
    """
    path = written_once(spark, name, key, lambda p: build().write.mode("overwrite").parquet(p))
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per application), so that they need no PYTHONPATH."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "cyclelake-package.zip")  # served to the executors by the driver
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)
