"""Tables that an operator writes to cut its lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PREFIX = "murmur-llm-"


def base_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset one is made on one machine, as in tests; a cluster has no
    folder then that all its machines see, and this raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix=PREFIX)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own below the shared one; every run takes another."""
    return f"{base_folder(spark)}/{PREFIX}{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows of df, written once as Parquet and read again. Later plans start from the files, so a lost executor
    costs a read, and Spark knows the size of the table when it chooses a join."""
    path = folder or new_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes one folder that new_folder has named, through the file system of its path."""
    if PREFIX not in path:
        raise ValueError(f"not a folder of this library: {path}")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
