"""Filters, checks and lookups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from freshet.operators.joins import lookup
from freshet.operators.staging import shared
from freshet.functions.numeric import col
from freshet.functions.text import normalize_name

# How a usable daily-weather station id looks, and the two site networks.
WX_ID_PATTERN = r"^US[a-zA-Z0-9_]{6}\d+"
COUNTRY = "US"
SITE_PREFIXES = ("DWR", "USGS")
#: Requests whose least size is sent to every task, under a hundred bytes each.
SENT_SIZES = 500_000


def day(value: Column | str | dt.date) -> Column:
    """A date argument as a Column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def moment(value: Column | str | dt.date) -> Column:
    """A date or, with a time of day, a timestamp argument as a Column."""
    timed = isinstance(value, dt.datetime) or isinstance(value, str) and len(value.strip()) > 10
    return F.lit(str(value)).cast("timestamp") if timed else day(value)


def is_timed(df: DataFrame, value: Column) -> bool:
    """Does the expression carry times of day?"""
    return isinstance(df.select(value).schema[0].dataType, (TimestampType, TimestampNTZType))


def not_after(df: DataFrame, value: Column, end: Column) -> Column:
    """``value`` is up to ``end``; an end that is a date includes its whole day.

    The day is closed by the first moment after it, so that the comparison with a
    column stays one that a scan can take.
    """
    if is_timed(df, value) and not is_timed(df, end):
        return value < F.date_add(end, 1)
    return value <= end


def not_before(df: DataFrame, value: Column, start: Column) -> Column:
    """``value`` is from ``start``; a value that is a date stands for its whole day."""
    if is_timed(df, start) and not is_timed(df, value):
        return value >= start.cast("date")
    return value >= start


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def prefixed_columns(df: DataFrame, prefix: str = "station_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def parse_site_keys(df: DataFrame, key: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split ``PREFIX:id`` keys; returns (known sites, rejected keys)."""
    parts = F.split(col(key), ":", -1)
    split = df.select(F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("site_id"),
                      col(key).alias("station_id"), (F.size(parts) == 2).alias("_ok"))
    good = F.coalesce(F.col("_ok") & F.col("prefix").isin(*SITE_PREFIXES), F.lit(False))
    return (split.where(good).drop("_ok"), split.where(~good).select("station_id", "prefix"))


def by_country(df: DataFrame, country: str = COUNTRY, wx_id: str = "wx_id") -> DataFrame:
    return df.where(col(wx_id).startswith(country))


def filter_wx_stations(df: DataFrame, wx_id: str = "wx_id") -> DataFrame:
    """Stations of the country whose id has the usable form (anchored at its start only)."""
    return by_country(df, wx_id=wx_id).where(col(wx_id).rlike(WX_ID_PATTERN))


def fit_stations(meta: DataFrame, start, end, min_coverage: float = 0.87,
                 grace_days: int = 3) -> DataFrame:
    """Stations with enough coverage over the range.

    The grace period counts back from the start of the range.
    """
    start, end = day(start), day(end)
    return meta.where(
        (F.col("datacoverage") > min_coverage)
        & ((F.col("maxdate") >= end) | (F.col("maxdate") >= F.date_sub(start, grace_days)))
        & (F.col("mindate") <= start))


def has_all_fields(fields: DataFrame, required: Sequence[str] = ("TMIN", "TMAX"),
                   key: str | Sequence[str] = "wx_id", field: str = "datatype") -> DataFrame:
    """Keys that offer every required field.

    One flag per required field, combined map-side: nothing is collected per key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    flags = [F.max(col(field) == name).alias(f"_f{i}") for i, name in enumerate(required)]
    found = (fields.where(col(field).isin(*required))
                   .groupBy(*map(col, keys)).agg(*flags))
    for i in range(len(required)):
        found = found.where(f"_f{i}")
    return found.select(*map(col, keys))


def date_range(df: DataFrame, start, end, date: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end``, both in: of timestamps the whole last day.  A reversed range is an error."""
    if not isinstance(start, Column) and not isinstance(end, Column) and str(end) < str(start):
        raise ValueError("end date is before start date")
    return df.where(not_before(df, col(date), moment(start)) & not_after(df, col(date), moment(end)))


def valid_cells(df: DataFrame, value: str = "value") -> DataFrame:
    """Drop cells without a value (fill values became NULL when they were read)."""
    return df.where(col(value).isNotNull())


def fill_to_null(df: DataFrame, cols: Sequence[str], fill: float | Column = -9999.0) -> DataFrame:
    """A source's fill value becomes NULL."""
    mark = fill if isinstance(fill, Column) else F.lit(fill)
    return df.withColumns({c: F.nullif(col(c), mark) for c in cols})


def find_products(catalog: DataFrame, term: str = "soil moisture",
                  description: str = "description") -> DataFrame:
    """Products whose description contains the term, ignoring case."""
    return catalog.where(F.contains(F.lower(F.coalesce(col(description), F.lit(""))), F.lit(term.lower())))


def pick_layer(layers: DataFrame, term: str = "soil_moisture", by: str = "product",
               order: str = "ordinal") -> DataFrame:
    """Per product, the first layer whose name or description contains the term."""
    hit = F.lit(term.lower())
    found = layers.where(F.contains(F.lower(F.col("layer")), hit)
                         | F.contains(F.lower(F.coalesce(F.col("description"), F.lit(""))), hit))
    rest = [c for c in layers.columns if c != by]
    return (found.groupBy(col(by)).agg(F.min_by(F.struct(*map(col, rest)), col(order)).alias("_r"))
                 .select(col(by), "_r.*"))


def granules_for(granules: DataFrame, bbox, start, end) -> DataFrame:
    """Granules that overlap a time range, its last day included, and a (min_lon, min_lat, max_lon, max_lat) box."""
    min_lon, min_lat, max_lon, max_lat = (b if isinstance(b, Column) else F.lit(float(b)) for b in bbox)
    return granules.where(
        not_after(granules, F.col("start"), moment(end)) & not_before(granules, F.col("end"), moment(start))
        & (F.col("min_lon") <= max_lon) & (F.col("max_lon") >= min_lon)
        & (F.col("min_lat") <= max_lat) & (F.col("max_lat") >= min_lat))


def smallest_granule(granules: DataFrame, by: str | Sequence[str] = "request_id") -> DataFrame:
    """The smallest granule of each request, one without a size before all others; equal sizes go by id.

    The least size is found first, in a few bytes per request, so that only
    granules of that size are sorted by request.  Runs the plan of ``granules`` twice.
    The sizes are written, and up to ``SENT_SIZES`` of them sent to all tasks, so that
    the granules of all requests need not be shuffled to be told from the smallest.
    """
    by = [by] if isinstance(by, str) else list(by)
    rest = [c for c in granules.columns if c not in by]
    unknown = F.bool_or(F.col("size_mb").isNull())
    least = shared(granules.groupBy(*map(col, by)).agg(F.when(~unknown, F.min("size_mb")).alias("size_mb")), "least")
    few = least.count() <= SENT_SIZES
    granules = lookup(granules, F.broadcast(least) if few else least, [*by, "size_mb"], how="left_semi", salts=1)
    best = F.min_by(F.struct(*map(col, rest)), F.struct("size_mb", "granule_id"))
    return granules.groupBy(*map(col, by)).agg(best.alias("_g")).select(*map(col, by), "_g.*")


def latest_scene(scenes: DataFrame, as_of, days: int = 30, by: str = "dataset",
                 taken: str = "acquisition_date", tie: str = "scene_id") -> DataFrame:
    """Per dataset, the newest scene of the ``days`` days up to ``as_of``, that day included."""
    as_of = day(as_of)
    recent = scenes.where(not_before(scenes, col(taken), F.date_sub(as_of, days)) & not_after(scenes, col(taken), as_of))
    rest = [c for c in scenes.columns if c != by]
    newest = F.max_by(F.struct(*map(col, rest)), F.struct(col(taken), col(tie)))
    return recent.groupBy(col(by)).agg(newest.alias("_s")).select(col(by), "_s.*")


def lookup_sites(requests: DataFrame, inventory: DataFrame, key: str | Sequence[str] = "site_id") -> DataFrame:
    """Coordinates of requested sites by exact id; unknown ids keep NULL coordinates.

    Inventories are landed again and again; of the lines of one site the first
    counts, in the order of their values, so every request stays one row.
    """
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in inventory.columns if c not in key]
    first = inventory.groupBy(*map(col, key)).agg(F.min(F.struct(*map(col, rest))).alias("_first")).select(*map(col, key), "_first.*")
    return lookup(requests, first, key)


def resolve_basin(requests: DataFrame, basins: DataFrame) -> DataFrame:
    """Attach the snow source to (basin_name, basin_type) requests.

    Names are normalised on both sides; unknown types and names give no row.
    """
    dim = basins.select(F.lower("basin_type").alias("_type"), normalize_name(F.col("basin")).alias("_name"),
                        F.col("basin"), F.col("source"))
    r = requests.withColumns({"_type": F.lower("basin_type"), "_name": normalize_name(F.col("basin_name"))})
    return r.join(dim, ["_type", "_name"]).drop("_type", "_name")


def preview(df: DataFrame, order: Sequence[str], n: int = 4) -> DataFrame:
    """The first and the last ``n`` rows in a stated order, tagged ``head`` and ``tail``."""
    first = df.orderBy(*map(col, order)).limit(n).withColumn("part", F.lit("head"))
    last = df.orderBy(*[col(c).desc() for c in order]).limit(n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of each named frame."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
