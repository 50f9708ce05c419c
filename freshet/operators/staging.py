"""Intermediate tables that several later steps read, in storage that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may go without, where driver and tasks share
    the disk: it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="freshet-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; :func:`release` removes it."""
    path = f"{shared_folder(spark)}/freshet-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def shared(df: DataFrame, name: str = "table") -> DataFrame:
    """Run the plan into a Parquet table in shared storage and read that instead.

    For a frame that several branches of a plan need: each would compute it again
    otherwise.  A written table tells the optimizer its true size, holds no memory
    of executors, and outlives them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Remove the tables written so far: to be called when nothing reads a result any more, and at the end of the driver."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        context = spark.sparkContext
        if SparkContext._active_spark_context is not context:  # the session went first; only it knows the storage
            continue
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(release)
