"""Tables that Python workers write themselves.

Where the shared folder is a local path and Hadoop's native library is absent, each folder and file that Spark's writer
makes starts `chmod` from the executor's JVM; until that process has replaced itself it counts as that JVM a second time.
A worker's own file starts none. Tables in any other store go through Spark's writer.

Each partition is one file, under its own name from the moment it is whole: a task that runs again replaces it. Empty
partitions have none. Names of unfinished files begin with `_`, which Spark skips.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def local_path(spark: SparkSession, path: str) -> str | None:
    """path in the file system of the machine, if that is where it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_file(batches: Iterator[pa.RecordBatch], folder: str, part: int, group_bytes: int = 16_000_000) -> int:
    """One Parquet file of all batches, in row groups of about `group_bytes`; returns its rows."""
    tmp, rows, held, size, out = f"{folder}/_{part}.{uuid.uuid4().hex}", 0, [], 0, None
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or pq.ParquetWriter(tmp, batch.schema)
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if size >= group_bytes:
                out.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if out:
            if held:
                out.write_table(pa.Table.from_batches(held))
            out.close()
            os.replace(tmp, f"{folder}/part-{part:06}.parquet")
    finally:
        with contextlib.suppress(OSError):
            os.remove(tmp)
    return rows


def saved(df: DataFrame, rows: Rows, schema: str | StructType, path: str) -> DataFrame:
    """df.mapInArrow(rows, schema) as a table in `path`."""
    spark = df.sparkSession
    if folder := local_path(spark, path):

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"n": pa.array([write_file(rows(batches), folder, TaskContext.get().partitionId())], pa.int64())})

        os.makedirs(folder)
        df.mapInArrow(save, "n long").count()
    else:
        df.mapInArrow(rows, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered(rows: Rows) -> Rows:
    """With a column `row` behind, another number for each row of the table, as monotonically_increasing_id gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in rows(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(at, at + batch.num_rows), pa.int64())], names=[*batch.schema.names, "row"])
            at += batch.num_rows

    return run
