"""Expressions over a polygon ring, ``array<struct<lon, lat>>``.

A ring arrives as one value of one record, so all of this is row-local: no
shuffle, no window over vertices, and no polygon can make a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.numeric import col


def _last(ring: Column) -> Column:
    return F.try_element_at(ring, F.lit(-1))


def drop_repeats(ring: Column) -> Column:
    """Remove points equal to the one just before them."""
    return F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))


def close_ring(ring: Column) -> Column:
    """Append the first point unless the ring already ends there."""
    first = F.get(ring, F.lit(0))
    return F.when(first == _last(ring), ring).otherwise(F.concat(ring, F.array(first)))


def ring_edges(ring: Column) -> Column:
    """Consecutive point pairs as ``array<struct<x1, y1, x2, y2>>``."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n),
        lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"),
                              b["lon"].alias("x2"), b["lat"].alias("y2")))


def orientation_sum(ring: Column) -> Column:
    """Sum of (x2 - x1) * (y2 + y1) over the edges; negative means counter-clockwise."""
    return F.aggregate(ring_edges(ring), F.lit(0.0),
                       lambda s, e: s + (e["x2"] - e["x1"]) * (e["y2"] + e["y1"]))


def is_ccw(ring: Column) -> Column:
    return orientation_sum(ring) < 0


def ring_bbox(ring: Column) -> Column:
    """``struct<min_lon, min_lat, max_lon, max_lat>``."""
    lons, lats = ring["lon"], ring["lat"]
    return F.struct(F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"),
                    F.array_max(lons).alias("max_lon"), F.array_max(lats).alias("max_lat"))


def clean_rings(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Drop repeated points, close, and turn every ring counter-clockwise."""
    # One step per projection, so that no step evaluates the one before it twice.
    return (df.withColumn(ring, drop_repeats(col(ring)))
              .withColumn(ring, close_ring(col(ring)))
              .withColumn(ring, F.when(is_ccw(col(ring)), col(ring)).otherwise(F.reverse(col(ring)))))


def outer_ring(rings: Column) -> Column:
    """The outer ring of a polygon given as an array of rings."""
    return F.get(rings, F.lit(0))


def crosses_ray(e: Column, x: Column, y: Column) -> Column:
    """Does the edge cross the ray from (x, y) towards larger x?  Half-open in y."""
    span = (e["y1"] > y) != (e["y2"] > y)
    at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    return F.when(span, at > x).otherwise(F.lit(False))


def touches(e: Column, x: Column, y: Column) -> Column:
    """Is (x, y) exactly on the segment?"""
    on_line = (e["x2"] - e["x1"]) * (y - e["y1"]) == (x - e["x1"]) * (e["y2"] - e["y1"])
    return (on_line & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Strictly inside one given ring (even-odd); boundary points are outside.

    For testing a row's point against the row's own ring.  To match a table of
    points against a table of polygons use ``operators.spatial``.
    """
    edges = ring_edges(ring)
    inside = F.aggregate(edges, F.lit(False), lambda s, e: s != crosses_ray(e, x, y))
    return inside & ~F.exists(edges, lambda e: touches(e, x, y))


def edge_meets_box(e: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column,
                   slack: Column | float = 0.0) -> Column:
    """Does the segment touch the closed axis-aligned box?"""
    s = slack if isinstance(slack, Column) else F.lit(float(slack))
    near = ((F.least(e["x1"], e["x2"]) <= max_x + s) & (F.greatest(e["x1"], e["x2"]) >= min_x - s)
            & (F.least(e["y1"], e["y2"]) <= max_y + s) & (F.greatest(e["y1"], e["y2"]) >= min_y - s))
    nx, ny = e["y2"] - e["y1"], e["x1"] - e["x2"]
    to_centre = nx * ((min_x + max_x) / 2 - e["x1"]) + ny * ((min_y + max_y) / 2 - e["y1"])
    reach = F.abs(nx) * ((max_x - min_x) / 2 + s) + F.abs(ny) * ((max_y - min_y) / 2 + s)
    return near & (F.abs(to_centre) <= reach)


def intersects_bounds(ring: Column, bounds) -> Column:
    """Exact overlap test of a polygon with (min_lon, min_lat, max_lon, max_lat)."""
    min_x, min_y, max_x, max_y = (b if isinstance(b, Column) else F.lit(float(b)) for b in bounds)
    closed = close_ring(ring)
    # Edges that miss the box leave two cases: box inside polygon, or apart.
    return (F.exists(ring_edges(closed), lambda e: edge_meets_box(e, min_x, min_y, max_x, max_y))
            | ring_contains(closed, min_x, min_y))
