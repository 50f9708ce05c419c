"""The k nearest weather stations of every site, and the first usable one.

Exact, without pairing sites and stations.  Stations are counted on a hierarchy
of latitude/longitude cells.  From the coarsest cells down, each site keeps the
cells that can still hold one of its k nearest: the k-th smallest "farthest
corner" bounds the distance, cells whose nearest corner lies beyond it go.  Only
the surviving finest cells are opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.numeric import col, haversine_km, km_from_haversine
from freshet.functions.text import with_prefix
from freshet.operators.filters import filter_wx_stations, fit_stations, has_all_fields
from freshet.operators.joins import SALTS, Salts, equi_join, lookup
from freshet.operators.staging import shared

WX_PREFIX = "GHCND:"
# Cell sizes in degrees, each an eighth of the one before.  32 degrees cut the
# globe into at most 12 x 6 cells.
CELL_SIZES = (32.0, 4.0, 0.5, 0.0625, 0.0078125)
# Distances are compared to the millimetre, so that ties break by id and not by
# the last bit of a cosine.
KM_DIGITS = 6
_SLACK_KM = 1e-5


def _cell(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    return F.floor((lon + 180.0) / size), F.floor((lat + 90.0) / size)


def _sin2(deg: Column) -> Column:
    return F.pow(F.sin(F.radians(deg) / 2), 2)


def _bounds_km(lat: Column, lon: Column, cx: Column, cy: Column, size: float) -> tuple[Column, Column]:
    """Distances no point of the cell undercuts, and none exceeds.

    The haversine is a latitude term plus a longitude term; each is bounded by
    itself over the cell.
    """
    west, south = cx * size - 180.0, cy * size - 90.0
    east, north = west + size, F.least(south + size, F.lit(90.0))
    lat_gap = F.greatest(F.lit(0.0), south - lat, lat - north)
    lat_far = F.greatest(F.abs(lat - south), F.abs(lat - north))
    mid = F.abs(lon - (west + east) / 2) % 360.0
    off = F.least(mid, 360.0 - mid)  # longitude difference to the cell's middle
    lon_gap = F.greatest(F.lit(0.0), off - size / 2)
    lon_far = F.least(F.lit(180.0), off + size / 2)
    cos_lat = F.cos(F.radians(lat))
    cos_s, cos_n = F.cos(F.radians(south)), F.cos(F.radians(north))
    cos_low = F.greatest(F.lit(0.0), F.least(cos_s, cos_n))
    cos_high = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(cos_s, cos_n))
    low = _sin2(lat_gap) + cos_lat * cos_low * _sin2(lon_gap)
    high = _sin2(lat_far) + cos_lat * cos_high * _sin2(lon_far)
    return (km_from_haversine(F.least(F.lit(1.0), low)), km_from_haversine(F.least(F.lit(1.0), high)))


def _prune(frontier: DataFrame, k: int, size: float) -> DataFrame:
    """Drop the cells that cannot hold one of the point's k nearest stations."""
    low, high = _bounds_km(F.col("_plat"), F.col("_plon"), F.col("_cx"), F.col("_cy"), size)
    bounded = frontier.withColumns({"_low": low, "_high": high})
    point = W.partitionBy("_plat", "_plon")
    counted = bounded.withColumn("_sum", F.sum("_n").over(
        point.orderBy("_high", "_cx", "_cy").rowsBetween(W.unboundedPreceding, 0)))
    reach = F.min(F.when(F.col("_sum") >= k, F.col("_high"))).over(point)
    return (counted.withColumn("_reach", reach)
                   .where(F.col("_reach").isNull() | (F.col("_low") <= F.col("_reach") + _SLACK_KM))
                   .select("_plat", "_plon", "_cx", "_cy"))


def nearest_to_points(points: DataFrame, stations: DataFrame, k: int = 50,
                      sizes: Sequence[float] = CELL_SIZES, salts: Salts = SALTS) -> DataFrame:
    """(_plat, _plon, wx_id, km, rank) for distinct points; ranks run 1..k."""
    # Stations on one spot are ordered by id, so past k of them none can matter.
    on_spot = W.partitionBy("lat", "lon").orderBy("wx_id")
    cands = (stations.select("wx_id", "lat", "lon").where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
             .withColumn("_r", F.row_number().over(on_spot)).where(F.col("_r") <= k).drop("_r"))
    cx, cy = _cell(F.col("lat"), F.col("lon"), sizes[-1])
    leaves = shared(cands.withColumns({"_cx": cx, "_cy": cy}), "stations")  # every level counts them
    counts = [leaves.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))]
    for _ in sizes[1:]:
        counts.append(counts[-1].groupBy(F.shiftright("_cx", 3).alias("_cx"), F.shiftright("_cy", 3).alias("_cy"))
                                .agg(F.sum("_n").alias("_n")))
    counts.reverse()
    top = counts[0].agg(F.collect_list(F.struct("_cx", "_cy", "_n"))).scalar()  # at most 72 cells
    frontier = _prune(points.select("_plat", "_plon", F.inline(top)), k, sizes[0])
    for size, children in zip(sizes[1:], counts[1:]):
        parts = children.select(F.shiftright("_cx", 3).alias("_px"), F.shiftright("_cy", 3).alias("_py"),
                                "_cx", "_cy", "_n")
        frontier = _prune(_join_cells(frontier.withColumnsRenamed({"_cx": "_px", "_cy": "_py"}),
                                      parts, ["_px", "_py"], salts), k, size)
    pairs = _join_cells(frontier, leaves, ["_cx", "_cy"], salts)
    km = haversine_km(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon"))
    ranked = pairs.select("_plat", "_plon", "wx_id", km.alias("km")).withColumn(
        "rank", F.row_number().over(W.partitionBy("_plat", "_plon").orderBy(
            F.round("km", KM_DIGITS), "wx_id")))
    return ranked.where(F.col("rank") <= k)


def _join_cells(frontier: DataFrame, cells: DataFrame, keys: list[str], salts: Salts) -> DataFrame:
    """Open the cells of each point.

    The frontier is the work of all levels above, too dear to sketch: points
    crowding into one cell are left to the runtime's splitting, unless told.
    """
    return equi_join(frontier, cells, keys, 1 if salts is None else salts)


def _distinct_points(sites: DataFrame, lat: str, lon: str) -> DataFrame:
    return (sites.select(col(lat).alias("_plat"), col(lon).alias("_plon"))
                 .where(F.col("_plat").isNotNull() & F.col("_plon").isNotNull()).distinct())


def _back_to_sites(sites: DataFrame, found: DataFrame, site_id: str, lat: str, lon: str,
                   salts: Salts) -> DataFrame:
    """Give every site on a spot what was found for the spot."""
    keyed = sites.select(col(site_id), col(lat).alias("_plat"), col(lon).alias("_plon"))
    return equi_join(keyed, found, ["_plat", "_plon"], salts).drop("_plat", "_plon")


def nearest_stations(sites: DataFrame, stations: DataFrame, k: int = 50, site_id: str = "site_id",
                     lat: str = "lat", lon: str = "lon", salts: Salts = SALTS) -> DataFrame:
    """(site_id, wx_id, km, rank): each site's k nearest stations, nearest first."""
    found = nearest_to_points(_distinct_points(sites, lat, lon), stations, k, salts=salts)
    return _back_to_sites(sites, found, site_id, lat, lon, salts)


def nearest_fit_station(sites: DataFrame, stations: DataFrame, meta: DataFrame, fields: DataFrame,
                        start, end, k: int = 50, required: Sequence[str] = ("TMIN", "TMAX"),
                        site_id: str = "site_id", lat: str = "lat", lon: str = "lon",
                        min_coverage: float = 0.87, grace_days: int = 3,
                        salts: Salts = SALTS) -> DataFrame:
    """(site_id, noaa_station, km, rank): the first of the k nearest that is fit.

    Fit means enough coverage over the range and all required fields.  A site
    whose k nearest are all unfit gets no row, even if a fit one lies beyond.
    """
    fit = (fit_stations(meta, start, end, min_coverage, grace_days)
           .select(with_prefix(F.col("wx_id"), WX_PREFIX).alias("_wx")).distinct())
    complete = has_all_fields(fields.withColumn("_wx", with_prefix(F.col("wx_id"), WX_PREFIX)),
                              required, key="_wx")
    near = nearest_to_points(_distinct_points(sites, lat, lon), filter_wx_stations(stations), k, salts=salts)
    usable = lookup(near.withColumn("_wx", with_prefix(F.col("wx_id"), WX_PREFIX)),
                    fit.join(complete, "_wx"), ["_wx"], how="left_semi", salts=1)
    first = (usable.groupBy("_plat", "_plon")
                   .agg(F.min_by(F.struct(F.col("wx_id").alias("noaa_station"), "km", "rank"), F.col("rank")).alias("_b"))
                   .select("_plat", "_plon", "_b.*"))
    return _back_to_sites(sites, first, site_id, lat, lon, salts)
