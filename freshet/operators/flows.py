"""Discharge readings to daily values, and how they meet the weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.dates import lenient_date
from freshet.functions.numeric import col
from freshet.operators.filters import require_columns
from freshet.operators.joins import lookup
from freshet.operators.scaling import fill_mean
from freshet.operators.staging import shared

VALUE_COLUMNS = ("tmax", "tmin", "min_flow", "max_flow")


def daily_extremes(readings: DataFrame, station: str = "station_id", ts: str = "ts",
                   value: str = "flow") -> DataFrame:
    """Lowest and highest reading per station and local day.

    Combined map-side, so a station with a third of all readings shuffles one
    row per day and task.
    """
    return (readings.groupBy(col(station).alias("station_id"), F.to_date(col(ts)).alias("date"))
                    .agg(F.min(col(value)).alias("min_flow"), F.max(col(value)).alias("max_flow")))


def select_readings(df: DataFrame, start: Column, end: Column, fields: Sequence[str],
                    parameter: str | None = None, ts: str = "ts",
                    parameter_col: str = "parameter") -> DataFrame:
    """Readings of one parameter from ``start`` to ``end`` (both days in), some fields.

    Plain comparisons on the raw columns, so they reach the Parquet scan.
    """
    out = df.where((col(ts) >= start.cast("timestamp_ntz"))
                   & (col(ts) < F.date_add(end, 1).cast("timestamp_ntz")))
    if parameter is not None:
        out = out.where(col(parameter_col) == parameter)
    return out.select(*map(col, fields))


def drop_bad_stations(readings: DataFrame, station: str = "station_id",
                      bad: Column | None = None) -> DataFrame:
    """Strict mode: a station with any bad record loses all of its records."""
    bad = bad if bad is not None else (F.col("ts").isNull() | F.col("flow").isNull())
    marked = readings.where(F.coalesce(bad, F.lit(True))).select(col(station)).distinct()
    return lookup(readings, marked, [station], how="left_anti")


def sites_with_both(wx: DataFrame, flow: DataFrame, key: str = "station_id") -> tuple[DataFrame, DataFrame]:
    """Keep sites that have rows on both sides."""
    return (lookup(wx, flow.select(col(key)).distinct(), [key], how="left_semi"),
            lookup(flow, wx.select(col(key)).distinct(), [key], how="left_semi"))


def one_sided_sites(wx: DataFrame, flow: DataFrame, key: str = "station_id") -> DataFrame:
    """The sites ``sites_with_both`` drops, with the side that is missing."""
    a = wx.select(col(key)).distinct().withColumn("has_weather", F.lit(True))
    b = flow.select(col(key)).distinct().withColumn("has_flow", F.lit(True))
    both = a.join(b, key, "full")
    return (both.where(F.col("has_weather").isNull() | F.col("has_flow").isNull())
                .select(key, F.when(F.col("has_flow").isNull(), "no flow").otherwise("no weather").alias("reason")))


def drop_bad_date_sites(wx: DataFrame, flow: DataFrame, key: str = "station_id",
                        date: str = "date") -> tuple[DataFrame, DataFrame]:
    """One date that does not parse, on either side, removes the whole site.

    Missing dates count as well.  Surviving dates come back as dates.
    """
    require_columns(wx, [date])
    require_columns(flow, [date])
    bad = (wx.where(lenient_date(col(date)).isNull()).select(col(key))
           .unionByName(flow.where(lenient_date(col(date)).isNull()).select(col(key))).distinct())
    return tuple(lookup(side, bad, [key], how="left_anti").withColumn(date, lenient_date(col(date)))
                 for side in (wx, flow))


def merge_weather_flow(wx: DataFrame, flow: DataFrame, fill: bool = True, key: str = "station_id",
                       date: str = "date") -> DataFrame:
    """Full outer join on (date, station); gaps filled with the station's column mean.

    The day is part of the join key, which spreads a hot station over the shuffle.
    To fill, the joined rows are written to shared storage: the means and the
    rows both come from there, so the join runs once.
    """
    require_columns(wx, [date, key])
    require_columns(flow, [date, key])
    merged = wx.join(flow, [date, key], "full")
    present = [c for c in VALUE_COLUMNS if c in merged.columns]
    return fill_mean(shared(merged, "merged"), present, by=key) if fill and present else merged


def union_sites(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column one of them lacks is NULL there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
