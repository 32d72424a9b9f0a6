"""Spark session helpers.

Library code never creates its own session; these helpers are for tests,
the bench and the entry module. ``checkpoint_dir`` reads the cluster's
``spark.checkpoint.dir`` and only falls back to a local folder when the
setting is absent and the master is local (tests on one machine); on a
cluster a missing setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, driver_memory: str = "8g",
              **conf) -> SparkSession:
    builder = SparkSession.builder.appName("flowlens")
    if master:
        builder = builder.master(master)
        # local mode: the driver JVM is the only executor (takes effect for a new JVM)
        builder = builder.config("spark.driver.memory", driver_memory)
    settings = dict(DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k: str(v) for k, v in conf.items()})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in settings.items():
        if not k.startswith("spark.ui") and not k.startswith("spark.driver"):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an already running session
                pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``flowlens`` importable in Python workers (like ``--py-files``).

    Arrow / pandas-state operators pickle module-level helpers by reference,
    so workers import the package. The package is zipped on the driver and
    handed to ``SparkContext.addPyFile``, which distributes it to executors;
    once per application.
    """
    import shutil
    import tempfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="flowlens-pyfiles-")
    archive = shutil.make_archive(os.path.join(staging, "flowlens"), "zip", os.path.dirname(pkg), "flowlens")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a local master (tests) may go without the setting."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="flowlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to a fresh folder under the shared checkpoint folder, and read again.

    For a table that several parts of a plan read: it is computed once, each
    part reads its own columns only, and a lost executor re-reads files.
    """
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
