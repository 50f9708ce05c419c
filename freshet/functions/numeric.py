"""Number expressions: coercion, distances, projections, rounding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

EARTH_RADIUS_KM = 6371.0
MERCATOR_RADIUS_M = 6378137.0
# Java's parser also takes "1d" or "0x1p3" for a double; only plain numbers count here.
_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c: Column | str) -> Column:
    """A Column from a Column or a literal column name (dots and colons included)."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def nan_to_null(c: Column) -> Column:
    """Missing values are NULL everywhere inside; NaN would poison every average."""
    return F.nanvl(c, F.lit(None).cast("double"))


def number_from_text(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    return F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double"))


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Make ``cols`` double; unparseable, blank and NaN values become NULL."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for name in cols:
        c = col(name)
        out[name] = number_from_text(c) if isinstance(kinds[name], T.StringType) \
            else nan_to_null(c.try_cast("double"))
    return df.withColumns(out)


def haversine_a(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The haversine of the central angle, clamped to [0, 1]."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = p2 - p1, F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))


def km_from_haversine(a: Column) -> Column:
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres on a sphere of radius 6371 km."""
    return km_from_haversine(haversine_a(lat1, lon1, lat2, lon2))


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """WGS84 degrees to spherical web-mercator metres, as (x, y)."""
    x = MERCATOR_RADIUS_M * F.radians(lon)
    y = MERCATOR_RADIUS_M * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))
    return x, y


def _cross(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    return (x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)


def perpendicular_distance(x1: Column, y1: Column, x2: Column, y2: Column,
                           x: Column, y: Column) -> Column:
    """Distance of (x, y) from the infinite line through two points; 0 if they coincide."""
    length = F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))
    return F.when(length == 0, F.lit(0.0)).otherwise(
        F.abs(_cross(x1, y1, x2, y2, x, y)) / length)


def is_point_on_line(x1: Column, y1: Column, x2: Column, y2: Column,
                     x: Column, y: Column) -> Column:
    """Exact collinearity with the infinite line (not the segment)."""
    return (x2 - x1) * (y1 - y) == (x1 - x) * (y2 - y1)


def round_coord(c: Column, digits: int = 6) -> Column:
    """Round coordinates half-even, as coordinates are published."""
    return F.bround(c, digits)


def radii(max_distance: float, steps: int = 5) -> Column:
    """``steps`` evenly spaced radii from 0 to ``max_distance`` as an array."""
    if steps < 2:
        return F.array(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)),
                       lambda i: i * F.lit(float(max_distance)) / F.lit(float(steps - 1)))


def in_bbox(lon: Column, lat: Column, bounds, margin: float | Column = 0.0) -> Column:
    """Inside (min_lon, min_lat, max_lon, max_lat), grown by ``margin`` on every side."""
    min_lon, min_lat, max_lon, max_lat = (
        b if isinstance(b, Column) else F.lit(float(b)) for b in bounds)
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    return ((lon >= min_lon - m) & (lon <= max_lon + m)
            & (lat >= min_lat - m) & (lat <= max_lat + m))
