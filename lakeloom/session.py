"""Sessions with the settings that the library's queries expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "lakeloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; on a cluster the master and sizes come from its own settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of its own under a local master."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")
