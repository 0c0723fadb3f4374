"""Cutting long plans at tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, which only a session in one process may use."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        master = sc.master.split("[")[0]
        if master != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="velado-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/velado-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: nothing before it is computed twice, or lost with an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder, in whichever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """The tables of one job, in a folder of their own: written by name, dropped by name once nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            removed(self.spark, f"{self.folder}/{name}")
