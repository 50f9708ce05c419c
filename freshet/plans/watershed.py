"""Jobs that start from a point and work on the watershed around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.numeric import col
from freshet.functions.rings import clean_rings, intersects_bounds, ring_bbox
from freshet.operators.filters import date_range, day, moment, resolve_basin, smallest_granule, valid_cells
from freshet.operators.grids import cells_with_coords, clip_cells, spatial_mean_by_time, zonal_mean_expanding
from freshet.operators.joins import SALTS, Salts, dealt_out, lookup
from freshet.operators.simplify import simplify_rings
from freshet.operators.snow import swe_to_daily
from freshet.operators.staging import shared
from freshet.operators.spatial import granules_for_requests, huc_for_points


def basin_snow(requests: DataFrame, basins: DataFrame, wide: DataFrame, start, end) -> DataFrame:
    """Daily snow of requested basins.  ``wide`` is keyed by the basin's name or its file."""
    if not isinstance(start, Column) and not isinstance(end, Column) and str(end) < str(start):
        raise ValueError("end date is before start date")
    wanted = resolve_basin(requests, basins)
    stem = F.regexp_extract("source", r"([^/]*?)\.[^./]*$", 1)
    keys = wanted.select("basin_name", "basin_type", F.explode(F.array_distinct(F.array("basin", stem))).alias("basin"))
    hits = wide.join(keys, "basin")
    return swe_to_daily(hits, start, end, keys=("basin_name", "basin_type"))


def simplified_hucs(polygons: DataFrame, level: int, tolerance: float = 0.005) -> DataFrame:
    """One level's rings, simplified and cleaned, keyed ``polygon_id``."""
    at_level = polygons.where(F.col("huc_level") == level)
    return clean_rings(simplify_rings(at_level, tolerance)).withColumn("polygon_id", F.col("huc_id"))


def _used(points: DataFrame, polygons: DataFrame, level: int, point_id: str, tolerance: float,
          salts: Salts) -> tuple[DataFrame, DataFrame]:
    """(point -> polygon, the simplified polygons that hold a point), both shared.

    Placing the points and simplifying in Python are the dear parts; what follows
    reads both results several times.
    """
    found = shared(huc_for_points(points, polygons, level, point_id=point_id, salts=salts))
    used = polygons.where(F.col("huc_level") == level).join(found.select("huc_id").distinct(), "huc_id", "left_semi")
    return found, shared(simplified_hucs(dealt_out(used), level, tolerance))


def huc_boundary(points: DataFrame, polygons: DataFrame, level: int = 8, bounds: Sequence[float] | None = None,
                 tolerance: float = 0.005, point_id: str = "point_id", salts: Salts = SALTS) -> DataFrame:
    """Each point's watershed with its simplified ring, and whether it meets ``bounds``."""
    found, rings = _used(points, polygons, level, point_id, tolerance, salts)
    rings = rings.select("huc_id", "ring")
    if bounds is not None:
        rings = rings.withColumn("meets_bounds", intersects_bounds(F.col("ring"), bounds))
    return lookup(found, rings, ["huc_id"], how="inner", salts=salts)


def huc_soil_moisture(points: DataFrame, polygons: DataFrame, granules: DataFrame, cells: DataFrame, start, end,
                      level: int = 8, max_distance: float = 0.1, tolerance: float = 0.005,
                      point_id: str = "point_id", salts: Salts = SALTS) -> DataFrame:
    """Mean soil moisture around each point, from the smallest granule over its watershed.

    Work is done once per watershed, then handed to the points in it.
    """
    found, rings = _used(points, polygons, level, point_id, tolerance, salts)
    boxed = rings.select("polygon_id", "ring", ring_bbox(F.col("ring")).alias("b"))
    requests = boxed.select(F.col("polygon_id").alias("request_id"), moment(start).alias("start"), moment(end).alias("end"), "b.*")
    chosen = shared(smallest_granule(granules_for_requests(requests, granules, salts=salts)).select(
        F.col("request_id").alias("polygon_id"), F.col("granule_id")))
    # Most granules are nobody's choice: drop their cells before the spatial join, in
    # which the granule is part of the key, so a polygon only meets cells of its own.
    usable = shared(lookup(valid_cells(cells).select("grid_id", "lat", "lon", "value"), chosen.select(F.col("granule_id").alias("grid_id")).distinct(),
                           ["grid_id"], how="left_semi", salts=salts), "cells")
    wanted = boxed.select("polygon_id", "ring").join(chosen, "polygon_id")
    means = zonal_mean_expanding(usable, wanted, max_distance, salts=salts, same=("grid_id", "granule_id"), inside_first=False)
    per_huc = shared(chosen.join(means, "polygon_id", "left").withColumnRenamed("polygon_id", "huc_id"), "means")
    return lookup(found, per_huc, ["huc_id"], salts=salts)


def huc_drought_cells(points: DataFrame, polygons: DataFrame, cells: DataFrame, transform, level: int = 8,
                      tolerance: float = 0.005, point_id: str = "point_id", salts: Salts = SALTS, on=None,
                      date: str = "ts") -> DataFrame:
    """Drought-index cells in the watersheds that hold a point: (polygon_id, latitude, longitude, value).

    ``on`` picks the cells of one day, by their column ``date``; without it every cell counts.
    """
    _, rings = _used(points, polygons, level, point_id, tolerance, salts)
    if on is not None:
        cells = cells.where(col(date).cast("date") == day(on))
    placed = cells_with_coords(cells, transform)
    inside = clip_cells(placed, rings.select("polygon_id", "ring"), salts=salts)
    return inside.select("polygon_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "value")


def huc_moisture_series(points: DataFrame, polygons: DataFrame, cells: DataFrame, start, end,
                        half: tuple[float, float], level: int = 8, tolerance: float = 0.005,
                        point_id: str = "point_id", salts: Salts = SALTS) -> DataFrame:
    """Per watershed that holds a point and day, the mean over every cell it touches."""
    _, rings = _used(points, polygons, level, point_id, tolerance, salts)
    in_range = date_range(cells, start, end, date="ts")
    touched = clip_cells(in_range, rings.select("polygon_id", "ring"), all_touched=True, half=half, salts=salts)
    return spatial_mean_by_time(touched)
