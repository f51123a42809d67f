"""A local session with the settings the queries are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """One machine, so a temporary folder is one that driver and executors share."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("murmur")
             .config("spark.sql.shuffle.partitions", str(partitions or cpus))
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="murmur-"))
             .config("murmur.text.parts", str(cpus))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
