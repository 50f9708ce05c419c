"""Explicit schemas of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

DOUBLE, STRING, DATE, LONG, INT = (
    T.DoubleType(), T.StringType(), T.DateType(), T.LongType(), T.IntegerType())


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STATION = _table(
    ("id", STRING), ("abbreviation", STRING), ("name", STRING),
    ("latitude", DOUBLE), ("longitude", DOUBLE), ("usgs_site_id", STRING),
    ("county", STRING), ("state", STRING), ("division", STRING),
    ("water_district", STRING), ("data_source", STRING), ("start_date", STRING),
    ("end_date", STRING), ("measurement_unit", STRING), ("last_reading", DOUBLE),
    ("last_reading_date", STRING))

FLOW_READING = _table(("station_id", STRING), ("ts", T.TimestampNTZType()), ("flow", DOUBLE))
FLOW_DAILY = _table(("station_id", STRING), ("date", DATE), ("min_flow", DOUBLE), ("max_flow", DOUBLE))
WX_STATION = _table(("wx_id", STRING), ("lat", DOUBLE), ("lon", DOUBLE))
WX_STATION_META = _table(("wx_id", STRING), ("datacoverage", DOUBLE), ("mindate", DATE), ("maxdate", DATE))
WX_STATION_FIELDS = _table(("wx_id", STRING), ("datatype", STRING))
WX_DAILY = _table(("noaa_station", STRING), ("date", DATE), ("tmin", DOUBLE), ("tmax", DOUBLE))
COMBINED = _table(
    ("date", DATE), ("station_id", STRING), ("tmin", DOUBLE), ("tmax", DOUBLE),
    ("min_flow", DOUBLE), ("max_flow", DOUBLE), ("noaa_station", STRING),
    ("usgs_site_id", STRING))
SWE_WIDE = _table(("basin", STRING), ("month_day", STRING), ("years", T.MapType(STRING, DOUBLE)))
SWE_DAILY = _table(("basin", STRING), ("date", DATE), ("swe", DOUBLE))

POINT = _table(("lon", DOUBLE), ("lat", DOUBLE))
RING = T.ArrayType(POINT)
HUC_POLYGON = _table(("huc_level", INT), ("huc_id", STRING), ("name", STRING), ("ring", RING))
GRID_CELL = _table(
    ("grid_id", STRING), ("ts", DATE), ("row", INT), ("col", INT),
    ("lat", DOUBLE), ("lon", DOUBLE), ("value", DOUBLE))
GRANULE = _table(
    ("granule_id", STRING), ("product", STRING), ("start", DATE), ("end", DATE),
    ("min_lon", DOUBLE), ("min_lat", DOUBLE), ("max_lon", DOUBLE), ("max_lat", DOUBLE),
    ("size_mb", DOUBLE))
SITE = _table(("prefix", STRING), ("site_id", STRING), ("station_id", STRING))
SITE_COORDS = _table(("site_id", STRING), ("lat", DOUBLE), ("lon", DOUBLE))
