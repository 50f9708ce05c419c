"""Landed river-gauge data: text and JSON readings, site lists, coordinates.

Each reader is split in two: ``parse_*`` works on a DataFrame of lines or
documents, ``read_*`` gets that from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.numeric import number_from_text
from freshet.operators.flows import drop_bad_stations

_RDB_STAMP = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"
_SPACED_STAMP = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
FLOW_JSON = "ResultList array<struct<abbrev:string,parameter:string,measDate:string,measValue:string,measUnit:string>>"


def _stamp(text: Column, shape: str) -> Column:
    return F.when(text.rlike(shape), text.try_cast("timestamp_ntz"))


def parse_flow_rdb(lines: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """Tab-separated instantaneous flow to (station_id, ts, flow).

    Comment, header and unit lines have no timestamp in the third field, so they
    go with the rows whose timestamp does not parse.  Local time is kept as it
    is.  A row whose flow is no number is skipped; ``strict`` drops its station.
    """
    parts = lines.where(~F.col(value).startswith("#")).select(F.split(value, "\t", -1).alias("p")).where(F.size("p") >= 5)
    rows = parts.select(F.get("p", F.lit(1)).alias("station_id"),
                        _stamp(F.substring(F.get("p", F.lit(2)), 1, 16), _RDB_STAMP).alias("ts"),
                        number_from_text(F.get("p", F.lit(4))).alias("flow")).where(F.col("ts").isNotNull())
    if strict:
        rows = drop_bad_stations(rows, bad=F.col("flow").isNull())
    return rows.where(F.col("flow").isNotNull())


def read_flow_rdb(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    return parse_flow_rdb(spark.read.text(path), strict=strict)


def parse_flow_json(docs: DataFrame, strict: bool = False, station: Column | None = None) -> DataFrame:
    """``ResultList`` documents to (station_id, ts, flow).

    Bad records are dropped; with ``strict`` they take their whole station along.
    ``station`` names the station where the records carry none.
    """
    recs = docs.select(F.explode("ResultList").alias("r"), *([station.alias("_s")] if station is not None else []))
    name = F.coalesce(F.col("r.abbrev"), F.col("_s")) if station is not None else F.col("r.abbrev")
    rows = recs.select(name.alias("station_id"), _stamp(F.col("r.measDate"), _SPACED_STAMP).alias("ts"),
                       number_from_text(F.col("r.measValue")).alias("flow"))
    if strict:
        rows = drop_bad_stations(rows)
    return rows.where(F.col("ts").isNotNull() & F.col("flow").isNotNull())


def read_flow_json(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    """One document per file; records without a station take the file's name."""
    docs = spark.read.schema(FLOW_JSON).json(path, multiLine=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return parse_flow_json(docs.select("ResultList", stem.alias("_stem")), strict, F.col("_stem"))


def parse_sites(lines: DataFrame, value: str = "value") -> DataFrame:
    """One ``PREFIX:id`` per line; blank lines go."""
    return lines.select(F.trim(value).alias("value")).where(F.col("value") != "")


def read_sites(spark: SparkSession, path) -> DataFrame:
    return parse_sites(spark.read.text(path))


def parse_site_inventory(lines: DataFrame, columns: tuple[str, ...] = ("site_no", "station_nm", "dec_lat_va", "dec_long_va"),
                         site: str = "site_no", lat: str = "dec_lat_va", lon: str = "dec_long_va",
                         value: str = "value") -> DataFrame:
    """Tab-separated inventory to (site_id, lat, lon).

    Header lines are those without numbers in the coordinate fields.
    """
    parts = lines.where(~F.col(value).startswith("#")).select(F.split(value, "\t", -1).alias("p"))

    def field(name: str) -> Column:
        return F.trim(F.get("p", F.lit(columns.index(name))))

    rows = parts.select(field(site).alias("site_id"), number_from_text(field(lat)).alias("lat"),
                        number_from_text(field(lon)).alias("lon"))
    return rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def read_site_inventory(spark: SparkSession, path) -> DataFrame:
    return parse_site_inventory(spark.read.text(path))


def parse_agency_coordinates(lines: DataFrame, columns: tuple[str, ...] = ("abbrev", "latitude", "longitude")) -> DataFrame:
    """The state agency's coordinates; pass ``columns`` in the order of the file."""
    return parse_site_inventory(lines, columns, "abbrev", "latitude", "longitude")


def read_agency_coordinates(spark: SparkSession, path,
                            columns: tuple[str, ...] = ("abbrev", "latitude", "longitude")) -> DataFrame:
    return parse_agency_coordinates(spark.read.text(path), columns)
