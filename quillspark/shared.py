"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    Only in local mode, where all tasks run on one machine, is a temporary folder taken
    instead if that setting is missing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at files that survive the loss of an executor, computes once what
    several parts of a plan read, and fixes columns that depend on how rows were dealt out.
    ``by`` names a column of few values whose rows are written apart, so that a test of it
    leaves the others' files unread; it becomes the last column.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if by:
        df = df.select(*[c for c in df.columns if c != by], by)
        df.write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over ``spark.sql.shuffle.partitions`` tasks; tests and columns that are not
    needed are still left out before it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialize`` gave and that no later plan reads."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
