"""Landed snow data: basin tables, station lists, daily station values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.functions.numeric import number_from_text
from freshet.functions.text import is_decimal_text

# The basins (HUC6) and sub-basins (HUC8) snow tables exist for,
# and for the names whose file is not simply the name with underscores, the file.
BASINS = (
    "south platte", "arkansas", "colorado headwaters", "yampa/white/little snake",
    "laramie and north platte", "upper_rio_grande", "san miguel/dolores/animas/san juan",
    "gunnison")
SUBBASINS = (
    "animas", "dolores", "san miguel", "mancos-la_plata", "upper san juan", "big thompson",
    "boulder", "cache la poudre", "clear", "north fork cache la poudre", "saint vrain",
    "upper south platte", "apishapa", "lower arkansas headwaters", "upper arkansas headwaters",
    "purgatoire", "cucharas & huerfano", "laramie", "north platte headwaters", "elk",
    "little snake", "white", "williams fork of the yampa", "yampa", "north fork gunnison",
    "surface-kannah", "uncompahgre", "uncompahgre plateau", "upper gunnison", "blue",
    "colorado/kremmling to glenwood springs", "eagle", "muddy", "plateau", "roaring fork",
    "troublesome", "williams fork", "willow", "alamosa", "conejos & rio sanantonio",
    "costilla", "culebra & trinchera", "headwaters rio grande", "northern san luis valley",
    "sagauche")
OTHER_FILES = {"conejos & rio sanantonio": "conejos_&_rio_san_antonio.json", "elk": "elk.jsonl"}
FOLDERS = {"basin": "assocHUCco_8", "subbasin": "assocHUCco2_8"}


def source_file(basin: str) -> str:
    return OTHER_FILES.get(basin, basin.replace("/", "-").replace(" ", "_") + ".json")


def basin_dim(spark: SparkSession, root: str = "") -> DataFrame:
    """(basin_type, basin, source): the fixed list above, under a landing folder."""
    prefix = f"{root.rstrip('/')}/" if root else ""
    rows = [(kind, name, f"{prefix}{FOLDERS[kind]}/{source_file(name)}")
            for kind, names in (("basin", BASINS), ("subbasin", SUBBASINS)) for name in names]
    return spark.createDataFrame(rows, "basin_type string, basin string, source string")


def parse_swe_wide(docs: DataFrame, value: str = "value", basin: str = "basin") -> DataFrame:
    """JSON arrays of {date: 'MM-DD', '<year>': value, ...} to (basin, month_day, years)."""
    days = docs.select(F.col(basin).alias("basin"), F.explode(F.from_json(value, "array<map<string,string>>")).alias("m"))
    years = F.transform_values(F.map_filter("m", lambda k, _: k != "date"), lambda _, v: number_from_text(v))
    return days.select("basin", F.try_element_at("m", F.lit("date")).alias("month_day"), years.alias("years"))


def read_swe_wide(spark: SparkSession, path) -> DataFrame:
    """One document per basin; the file's name is the basin (a year of days each)."""
    docs = spark.read.text(path, wholetext=True).select(
        "value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1).alias("basin"))
    return parse_swe_wide(docs)


def read_snow_stations(spark: SparkSession, path) -> DataFrame:
    """One station per line; those without a triplet cannot be asked for."""
    docs = spark.read.schema("stationTriplet string, name string, huc string, latitude double, longitude double").json(path)
    return docs.where(F.col("stationTriplet").isNotNull()).withColumnRenamed("stationTriplet", "triplet")


SNOW_DAILY_JSON = "stationTriplet string, data array<struct<values:array<struct<date:string,value:string>>>>"


def parse_snow_daily(docs: DataFrame) -> DataFrame:
    v = docs.select(F.col("stationTriplet").alias("triplet"), F.explode("data").alias("d")).select(
        "triplet", F.explode("d.values").alias("v"))
    return v.select("triplet", F.col("v.date").try_cast("date").alias("date"),
                    number_from_text(F.col("v.value")).alias("swe"))


def read_snow_daily(spark: SparkSession, path) -> DataFrame:
    return parse_snow_daily(spark.read.schema(SNOW_DAILY_JSON).json(path))


def parse_snow_report(lines: DataFrame, value: str = "value") -> DataFrame:
    """Report lines ``date,value``: comments, headers and lines of other shapes go."""
    p = F.split(value, ",", -1)
    rows = lines.where(~F.ltrim(value).startswith("#") & (F.size(p) == 2)).select(
        F.get(p, F.lit(0)).alias("date"), F.get(p, F.lit(1)).alias("_v"))
    return rows.where(is_decimal_text(F.col("_v"))).select(
        F.col("date").try_cast("date").alias("date"), number_from_text(F.col("_v")).alias("swe"))


def read_snow_report(spark: SparkSession, path) -> DataFrame:
    return parse_snow_report(spark.read.text(path))
