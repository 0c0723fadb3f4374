"""Settings that the queries want of a session. Operators change none; who owns the session calls this."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepared(spark: SparkSession, batch: str = "2m") -> SparkSession:
    """Arrow batches by bytes: rows of long texts would otherwise fill 64 MB at a time, in Python and in the JVM. A value
    that the session sets itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864", "67108864b"):
        spark.conf.set(key, batch)
    return spark
