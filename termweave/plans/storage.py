"""Durable intermediate tables: Parquet in the folder that all executors see."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Where tables go on a single machine without spark.checkpoint.dir, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Unset, there is a folder only for a master on one machine; a cluster needs its own."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_ and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (set_ or LOCAL_DIR).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the session's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends: lazy results read it until then."""

    def run() -> None:
        if path.startswith("file:"):  # needs no session, which may be gone
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
        elif spark.sparkContext._jsc is not None:
            remove(spark, path)

    atexit.register(run)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: what later plans read no longer depends on any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
