"""Landed watershed polygons.

A layer is one JSON document with all its features, however large.  It is read
by byte ranges, a feature a row: the way the file opens a feature is taken from
its beginning and serves as the separator of records.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.functions.nested import pairs_to_ring
from freshet.functions.rings import outer_ring
from freshet.operators.spatial import HUC_LEVELS, huc_code

HUC_JSON = """features array<struct<geometry:struct<rings:array<array<array<double>>>>,
attributes:struct<huc2:string,huc4:string,huc6:string,huc8:string,name:string>>>"""
GEOJSON = """features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,
properties:struct<huc2:string,huc4:string,huc6:string,huc8:string,name:string>>>"""


def _polygons(features: DataFrame, level: int, rings: str, attributes: str) -> DataFrame:
    if level not in HUC_LEVELS:
        raise ValueError(f"no watersheds of level {level}; there are {HUC_LEVELS}")
    a = F.col(attributes)
    return features.select(
        F.lit(level).alias("huc_level"), huc_code(F.lit(level), a["huc2"], a[f"huc{level}"], a["name"]).alias("huc_id"),
        a["name"].alias("name"), pairs_to_ring(outer_ring(F.col(rings))).alias("ring")).where(F.size("ring") > 0)


def parse_huc_polygons(docs: DataFrame, level: int, first_only: bool = False) -> DataFrame:
    """Features to (huc_level, huc_id, name, ring), outer rings only.

    A query answer lists its best match first: ``first_only`` keeps that one.
    """
    feature = F.slice("features", 1, 1) if first_only else F.col("features")
    return _polygons(docs.select(F.explode(feature).alias("f")), level, "f.geometry.rings", "f.attributes")


def parse_watershed_geojson(docs: DataFrame, level: int) -> DataFrame:
    return _polygons(docs.select(F.explode("features").alias("f")), level, "f.geometry.coordinates", "f.properties")


#: Pieces of a file's beginning that show how it opens a feature.
_HEAD = 200
_OPENING = re.compile(r'"features"\s*:\s*\[\s*(\{\s*(?:"type"\s*:\s*"Feature"|"(?:geometry|attributes|properties|id)"\s*:))')


def read_features(spark: SparkSession, path, schema: str) -> DataFrame:
    """The documents of ``schema``, (features), a feature to a row wherever it can be split off.

    Every feature of such a file opens alike, as files are written by programs;
    the text up to its first key separates the records, so a task reads a range
    of bytes and a row holds one feature.  Where that doesn't hold (a record with
    none or several geometries, a file that opens features in another way, or
    has none), the documents are read as wholes.
    """
    opening = _opening(spark, path)
    if opening is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    rows = spark.read.option("lineSep", opening).text(path)
    geometries = F.size(F.split(F.concat(F.lit(opening), "value"), r'"geometry"\s*:', -1)) - 1
    head = F.contains("value", F.lit('"features"'))
    odd = rows.where(F.when(head, geometries > F.lit(opening.count('"geometry"'))).otherwise(geometries != 1))
    if not odd.isEmpty():
        return spark.read.schema(schema).json(path, multiLine=True)
    feature = "".join(schema.split()).removeprefix("featuresarray<").removesuffix(">")
    # What follows a feature, a comma or the document's end, is no part of its value and not looked at.
    parsed = F.from_json(F.concat(F.lit(opening), "value"), feature)
    return rows.where(~head).select(F.array(parsed).alias("features"))


def _opening(spark: SparkSession, path) -> str | None:
    """How the files open a feature, by the first of them that is read; None if that can't be told."""
    pieces = spark.read.option("lineSep", "{").text(path).limit(_HEAD).collect()
    found = _OPENING.search("{".join(r.value for r in pieces))
    return found and found.group(1)


def read_huc_polygons(spark: SparkSession, path, level: int, first_only: bool = False) -> DataFrame:
    """Watershed query answers; with ``first_only`` each is read as a whole, as its order counts."""
    docs = spark.read.schema(HUC_JSON).json(path, multiLine=True) if first_only else read_features(spark, path, HUC_JSON)
    return parse_huc_polygons(docs, level, first_only)


def read_watershed_geojson(spark: SparkSession, path, level: int) -> DataFrame:
    """Watershed layers landed as GeoJSON, of any size."""
    return parse_watershed_geojson(read_features(spark, path, GEOJSON), level)


def ring_vertices(polygons: DataFrame, id_col: str = "huc_id", ring: str = "ring") -> DataFrame:
    """One row per vertex: (id, seq, lon, lat)."""
    return (polygons.select(id_col, F.posexplode(ring).alias("seq", "p"))
                    .select(id_col, "seq", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")))
