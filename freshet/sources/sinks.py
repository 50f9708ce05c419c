"""Writers, which run the plan, and readers of what they wrote."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

_BUCKET = "station_bucket"


def write_combined(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   buckets: int = 64, salts: int = 8) -> None:
    """The merged table, laid out by station.

    Stations go into a fixed number of folders by hash.  The rows of a folder are
    gathered by month and a salt before the write, so a task writes few folders
    and a hot station is written by many tasks.

    ``mode`` is one of Spark's, or ``stations``: the stations of ``df`` replace
    what is there of them and all others stay.  Only the folders of these
    stations are read and written anew, and they change when the job commits; the
    table must have been written with as many ``buckets``, or not be there yet.
    """
    out = df.withColumn(_BUCKET, F.pmod(F.xxhash64("station_id"), F.lit(buckets)).cast("int"))
    if mode == "stations":
        before = _there(df.sparkSession, path, fmt, out.schema)
        if before is not None:
            touched = [r[0] for r in out.select(_BUCKET).distinct().collect()]  # ``buckets`` at most
            others = before.where(F.col(_BUCKET).isin(touched)).join(out.select("station_id").distinct(), "station_id", "left_anti")
            out = others.select(*out.columns).unionByName(out)
    out = out.repartition(_BUCKET, F.trunc("date", "month"), F.pmod(F.xxhash64("station_id", "date"), F.lit(salts)))
    writer = out.sortWithinPartitions(_BUCKET, "station_id", "date").write.partitionBy(_BUCKET)
    writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if mode == "stations" else writer.mode(mode)
    _save(writer, path, fmt)


def read_combined(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The merged table with the columns it was written with."""
    layout = StructType([*schema.fields]).add(_BUCKET, IntegerType())
    return _reader(spark, fmt).schema(layout).load(path).drop(_BUCKET)


def write_normalized(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    _save(df.write.mode(mode), path, fmt)


def read_normalized(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    return _reader(spark, fmt).schema(schema).load(path)


def save_model(tables: Mapping[str, DataFrame], path: str) -> None:
    """A model as Parquet tables below one folder, what was there replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in schemas.items()}


def _save(writer, path: str, fmt: str) -> None:
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def _reader(spark: SparkSession, fmt: str):
    reader = spark.read.format(fmt)
    return reader.option("header", True) if fmt == "csv" else reader


def _there(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame | None:
    try:
        return _reader(spark, fmt).schema(schema).load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
