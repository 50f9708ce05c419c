"""Expressions over arrays, structs and JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from freshet.functions.dates import lenient_date
from freshet.functions.numeric import number_from_text
from freshet.functions.text import field_at

_POINT_JSON = "array<double>"
_POLYGON_JSON = "array<array<array<double>>>"


def first_where(arr: Column, pred: Callable[[Column], Column], field: str) -> Column:
    """``field`` of the first array element that passes, else NULL."""
    return F.try_element_at(F.filter(arr, pred), F.lit(1))[field]


def first_nested(arr: Column, *path: str) -> Column:
    """First element, then for each name the first element of that nested array."""
    out = F.get(arr, F.lit(0))
    for name in path:
        out = F.get(out[name], F.lit(0))
    return out


def pairs_to_ring(pairs: Column) -> Column:
    """``array<array<double>>`` of [lon, lat] to an array of point structs."""
    return F.transform(pairs, lambda p: F.struct(
        F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))


def parse_geometry(text: Column) -> Column:
    """GeoJSON text to ``struct<type, ring>``; NULL when it cannot be used.

    Accepts Point and Polygon.  Missing or other types, missing coordinates and
    coordinates of the wrong shape are all rejected.
    """
    doc = F.from_json(text, "type string, coordinates string")
    kind, coords = doc["type"], doc["coordinates"]
    point = F.from_json(coords, _POINT_JSON)
    outer = F.get(F.from_json(coords, _POLYGON_JSON), F.lit(0))
    point_ring = F.when(
        (F.size(point) >= 2) & F.get(point, F.lit(0)).isNotNull() & F.get(point, F.lit(1)).isNotNull(),
        F.array(F.struct(F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"))))
    polygon_ring = F.when(
        (F.size(outer) >= 3) & F.forall(outer, lambda p: F.coalesce(
            (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull(),
            F.lit(False))),
        pairs_to_ring(outer))
    ring = F.when(kind == "Point", point_ring).when(kind == "Polygon", polygon_ring)
    return F.when(ring.isNotNull(), F.struct(kind.alias("type"), ring.alias("ring")))


def point_request_ok(lat_lon: Column, day: Column) -> Column:
    """A ``"lat,lon"`` text with numbers in range and a ``yyyy-MM-dd`` date."""
    lat, lon = (number_from_text(field_at(lat_lon, ",", i)) for i in (0, 1))
    return F.coalesce(
        lat.between(-90, 90) & lon.between(-180, 180)
        & (F.size(F.split(lat_lon, ",", -1)) == 2)
        & day.rlike(r"^\d{4}-\d{2}-\d{2}$") & lenient_date(day).isNotNull(),
        F.lit(False))


def ring_to_geojson(ring: Column) -> Column:
    """A ring as Polygon GeoJSON text."""
    pairs = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")))
