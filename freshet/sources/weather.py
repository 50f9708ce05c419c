"""Landed weather data: station list, coverage, offered fields, daily values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.functions.dates import strict_date
from freshet.functions.numeric import nan_to_null, number_from_text
from freshet.functions.text import strip_quotes, with_prefix
from freshet.operators.nearest import WX_PREFIX

WX_META = "id string, datacoverage double, mindate string, maxdate string"
WX_FIELDS = "station string, dataTypes struct<buckets:array<struct<key:string>>>"


def parse_wx_stations(lines: DataFrame, value: str = "value") -> DataFrame:
    """Whitespace-separated list to (wx_id, lat, lon); later fields are ignored."""
    p = F.split(F.trim(value), r"\s+")
    return lines.select(F.get(p, F.lit(0)).alias("wx_id"), number_from_text(F.get(p, F.lit(1))).alias("lat"),
                        number_from_text(F.get(p, F.lit(2))).alias("lon")).where(F.col("wx_id") != "")


def read_wx_stations(spark: SparkSession, path) -> DataFrame:
    return parse_wx_stations(spark.read.text(path))


def parse_wx_meta(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("id").isNotNull()).select(
        with_prefix(F.col("id"), WX_PREFIX).alias("wx_id"), nan_to_null(F.col("datacoverage")).alias("datacoverage"),
        F.col("mindate").try_cast("date").alias("mindate"), F.col("maxdate").try_cast("date").alias("maxdate"))


def read_wx_meta(spark: SparkSession, path) -> DataFrame:
    """One station document per line."""
    return parse_wx_meta(spark.read.schema(WX_META).json(path))


def parse_wx_fields(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("station").alias("wx_id"), F.explode("dataTypes.buckets.key").alias("datatype"))


def read_wx_fields(spark: SparkSession, path) -> DataFrame:
    """One search answer per line, with the station it was asked for."""
    return parse_wx_fields(spark.read.schema(WX_FIELDS).json(path))


def parse_wx_daily(rows: DataFrame) -> DataFrame:
    """STATION, DATE, TMIN, TMAX text columns to (noaa_station, date, tmin, tmax).

    Blank temperatures are missing; a bad date is an error.
    """
    clean = {c: strip_quotes(F.col(c)) for c in ("STATION", "DATE", "TMIN", "TMAX")}
    return rows.select(clean["STATION"].alias("noaa_station"), strict_date(clean["DATE"]).alias("date"),
                       number_from_text(clean["TMIN"]).alias("tmin"), number_from_text(clean["TMAX"]).alias("tmax"))


def read_wx_daily(spark: SparkSession, path) -> DataFrame:
    """CSV with a header; every file is checked against it, and all columns stay text until coerced."""
    return parse_wx_daily(spark.read.csv(path, header=True, quote='"', ignoreLeadingWhiteSpace=True,
                                         ignoreTrailingWhiteSpace=True, enforceSchema=False))
