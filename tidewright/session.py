"""Session set-up."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC; NTZ inputs are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build(app: str = "tidewright", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` takes Spark settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one only where driver and executors are one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="tidewright-")
