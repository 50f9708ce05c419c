"""The combined dataset of all sites, its normalised form, and the station catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from freshet.functions.dates import lenient_date, lookback, year_fraction
from freshet.functions.numeric import coerce_numeric
from freshet.functions.text import blank_to_null
from freshet.operators.filters import day, lookup_sites, parse_site_keys, require_columns
from freshet.operators.flows import daily_extremes, merge_weather_flow, select_readings, union_sites
from freshet.operators.joins import HOT_ROWS, SALTS, Salts, equi_join
from freshet.operators.nearest import nearest_fit_station
from freshet.operators.scaling import fill_and_standardize, fill_mean, one_hot, one_hot_index
from freshet.operators.series import smooth_temperatures
from freshet.operators.staging import shared

NUMERIC = ("tmin", "tmax", "min_flow", "max_flow")


@dataclass(frozen=True)
class Sources:
    """The tables a combined dataset is built from."""

    sites: DataFrame        # value: PREFIX:id
    coordinates: DataFrame  # prefix, site_id, lat, lon
    readings: DataFrame     # prefix, station_id (the bare id), ts, flow
    wx_stations: DataFrame  # wx_id, lat, lon
    wx_meta: DataFrame      # wx_id, datacoverage, mindate, maxdate
    wx_fields: DataFrame    # wx_id, datatype
    wx_daily: DataFrame     # noaa_station, date, tmin, tmax


#: Days of a station that come out for each of its sites, in the mean.
_DAYS = 2_500


def weather_for_sites(sites: DataFrame, days: DataFrame, salts: Salts = SALTS) -> DataFrame:
    """Daily temperatures of each site's weather station, keyed by the site.

    Many sites can share one station; where so many do that their days are more
    than a task takes, the sites are split.
    """
    chosen = sites.select("station_id", "noaa_station", F.col("site_id").alias("usgs_site_id"))
    return equi_join(chosen, days, ["noaa_station"], salts, HOT_ROWS // _DAYS)


def build_dataset(sources: Sources, as_of, years: int = 7, salts: Salts = SALTS) -> tuple[DataFrame, DataFrame]:
    """(combined, rejects) for all sites.

    site -> coordinates -> nearest fit weather station -> its days, merged with the
    site's daily flow.  A site that cannot be completed does not stop the others;
    it is listed in ``rejects`` with the reason.

    Three tables are shared, each far smaller than what it is made from: daily
    flow (so the readings are scanned once), one status row per site, and the
    merged days (so that filling does not merge twice).
    """
    start, end = lookback(day(as_of), years * 365)
    sites, unknown = parse_site_keys(sources.sites)
    sites = sites.distinct()
    readings = sources.readings.withColumnRenamed("station_id", "site_id")
    in_range = select_readings(readings, start, end, ["prefix", "site_id", "ts", "flow"])
    # Reduce to days before looking at the site list: a hot gauge shrinks first.
    keyed = in_range.withColumn("station_id", F.concat_ws(":", "prefix", "site_id"))
    flow = shared(daily_extremes(keyed).join(sites.select("station_id"), "station_id", "left_semi"))

    wx_days = coerce_numeric(sources.wx_daily, ["tmin", "tmax"])
    bad_wx = wx_days.where(lenient_date(F.col("date")).isNull()).select("noaa_station").distinct()
    wx_days = wx_days.withColumn("date", lenient_date(F.col("date"))).where(F.col("date").between(start, end))
    # The same days are landed again and again; of a station's day the first by value counts.
    wx_days = wx_days.groupBy("noaa_station", "date").agg(F.min(F.struct("tmin", "tmax")).alias("_d")).select("noaa_station", "date", "_d.*")
    located = lookup_sites(sites, sources.coordinates, ["prefix", "site_id"])
    nearest = nearest_fit_station(located, sources.wx_stations, sources.wx_meta, sources.wx_fields, start, end,
                                  site_id="station_id", salts=salts).select("station_id", "noaa_station")
    with_days = (nearest.join(wx_days.select("noaa_station").distinct(), "noaa_station", "left_semi")
                        .join(bad_wx, "noaa_station", "left_anti"))
    with_flow = flow.select("station_id", F.lit(True).alias("has_flow")).distinct()
    status = shared(sites.select("station_id", "site_id").join(with_days, "station_id", "left")
                         .join(with_flow, "station_id", "left"))
    has_wx, has_flow = F.col("noaa_station").isNotNull(), F.col("has_flow").isNotNull()

    kept = status.where(has_wx & has_flow)
    wx = weather_for_sites(kept, wx_days.select("noaa_station", "date", "tmin", "tmax"), salts)
    merged = shared(merge_weather_flow(
        wx, flow.join(kept.select("station_id"), "station_id", "left_semi"), fill=False))
    combined = fill_mean(merged, list(NUMERIC), by="station_id").select(
        "date", "station_id", *NUMERIC, "noaa_station", "usgs_site_id")
    reason = F.when(has_wx, "no flow").when(has_flow, "no weather").otherwise("no data")
    rejects = union_sites([unknown.select("station_id", F.lit("unknown prefix").alias("reason")),
                           status.where(~(has_wx & has_flow)).select("station_id", reason.alias("reason"))])
    return combined, rejects


def normalize(df: DataFrame, window: int = 7, only_missing: bool = False, key: str = "station_id",
              station_values: Sequence[str] | None = None, keep_keys: bool = False) -> DataFrame:
    """Smooth, one-hot, coerce, fill, scale, year fraction, drop the date: in that order.

    Smoothing runs within a station, scaling over all of them.  The station comes
    out as ``station_index``, the position of its 1 in a one-hot vector, for any
    number of stations; with ``station_values`` as one boolean column for each of
    these.  ``keep_keys`` keeps the station and the date for the windows that follow.
    """
    require_columns(df, [*NUMERIC, "date", key])
    smoothed = smooth_temperatures(coerce_numeric(df, ["tmin", "tmax"]), key, "date", window, only_missing)
    rows = shared(coerce_numeric(blank_to_null(smoothed), NUMERIC))
    hot = (one_hot_index(rows, key, "station_index") if station_values is None
           else one_hot(rows, key, "station", station_values, drop=False))
    out = fill_and_standardize(hot, NUMERIC).withColumn("date_normalized", year_fraction(F.col("date")))
    return out if keep_keys else out.drop("date", key)


def build_station_catalog(dwr: DataFrame, usgs: DataFrame) -> DataFrame:
    """Both agencies' stations, duplicates included."""
    return dwr.unionByName(usgs)
