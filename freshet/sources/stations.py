"""Station catalogues of the two agencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.nested import first_nested, first_where
from freshet.functions.numeric import number_from_text
from freshet.schemas import STATION

_KINDS = {f.name: f.dataType for f in STATION.fields}

DWR_JSON = """ResultList array<struct<stationNum:string,abbrev:string,stationName:string,latitude:double,
longitude:double,usgsSiteId:string,county:string,state:string,division:string,waterDistrict:string,
dataSource:string,startDate:string,endDate:string,measUnit:string>>"""

USGS_JSON = """value struct<timeSeries:array<struct<
sourceInfo:struct<siteName:string,siteCode:array<struct<value:string,agencyCode:string>>,
  geoLocation:struct<geogLocation:struct<latitude:double,longitude:double>>,
  siteProperty:array<struct<value:string,name:string>>>,
variable:struct<unit:struct<unitCode:string>>,
values:array<struct<value:array<struct<value:string,dateTime:string>>>>>>>"""


def as_stations(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The 16 station columns, NULL where a source has none."""
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in _KINDS.items()])


def parse_stations_dwr(docs: DataFrame) -> DataFrame:
    r = docs.select(F.explode("ResultList").alias("r"))
    names = {"id": "stationNum", "abbreviation": "abbrev", "name": "stationName", "latitude": "latitude",
             "longitude": "longitude", "usgs_site_id": "usgsSiteId", "county": "county", "state": "state",
             "division": "division", "water_district": "waterDistrict", "data_source": "dataSource",
             "start_date": "startDate", "end_date": "endDate", "measurement_unit": "measUnit"}
    return as_stations(r, {k: F.col(f"r.{v}") for k, v in names.items()})


def parse_stations_usgs(docs: DataFrame) -> DataFrame:
    t = docs.select(F.explode("value.timeSeries").alias("t"))
    info = F.col("t.sourceInfo")
    code = first_where(info["siteCode"], lambda c: c["agencyCode"] == "USGS", "value")
    reading = first_nested(F.col("t.values"), "value")

    def prop(name: str) -> Column:
        return first_where(info["siteProperty"], lambda p: p["name"] == name, "value")

    return as_stations(t, {
        "id": code, "usgs_site_id": code, "name": info["siteName"],
        "latitude": info["geoLocation"]["geogLocation"]["latitude"],
        "longitude": info["geoLocation"]["geogLocation"]["longitude"],
        "county": prop("countyCd"), "state": prop("stateCd"), "data_source": F.lit("USGS"),
        "measurement_unit": F.col("t.variable.unit.unitCode"),
        "last_reading": number_from_text(reading["value"]), "last_reading_date": reading["dateTime"]})


def read_stations_dwr(spark: SparkSession, path) -> DataFrame:
    return parse_stations_dwr(spark.read.schema(DWR_JSON).json(path, multiLine=True))


def read_stations_usgs(spark: SparkSession, path) -> DataFrame:
    return parse_stations_usgs(spark.read.schema(USGS_JSON).json(path, multiLine=True))


def read_stations(spark: SparkSession, path, data_source: str) -> DataFrame:
    readers = {"DWR": read_stations_dwr, "USGS": read_stations_usgs}
    if data_source not in readers:
        raise ValueError(f"{data_source!r} lists no stations; known are {', '.join(readers)}")
    return readers[data_source](spark, path)
