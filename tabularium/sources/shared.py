"""The folder that driver and executors share, for tables that outlive a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in spark.checkpoint.dir; where that is unset, in local mode only, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read from a folder of its own: for what a plan holds more than once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input: sorted, never broadcast.

    Spark takes the rows of an explode for as many bytes as what they come from, so it would send sides to the driver that don't fit there.
    """
    return left.join(right.hint("merge"), on, how)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """The file system that holds a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table, to tell whether it has changed."""
    fs, where = file_system(spark, path)
    files = fs.listFiles(where, True)
    held = []
    while files.hasNext():
        f = files.next()
        held.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return "|".join(sorted(held))
