"""Snow water equivalent: day-by-year tables to daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.functions.numeric import col
from freshet.functions.text import is_digits
from freshet.operators.filters import date_range
from freshet.operators.joins import lookup


def swe_to_daily(wide: DataFrame, start, end, keys: tuple[str, ...] = ("basin",)) -> DataFrame:
    """(month_day, year -> value) rows to (date, swe), within start..end.

    Keys that are no years, empty values and February 29 of common years go.
    """
    long = wide.select(*map(col, keys), "month_day", F.explode("years").alias("_year", "swe"))
    dated = long.where(F.col("_year").rlike(r"^[0-9]{4}$") & F.col("swe").isNotNull()).select(
        *map(col, keys), F.concat("_year", F.lit("-"), "month_day").try_cast("date").alias("date"), "swe")
    return date_range(dated.where(F.col("date").isNotNull()), start, end)


def year_values(wide: DataFrame, first: int, last: int, out: str = "years") -> DataFrame:
    """Keep only the years first..last of each record's year map."""
    return wide.withColumn(out, F.map_filter(
        "years", lambda k, _: F.when(is_digits(k), k.try_cast("int").between(first, last)).otherwise(F.lit(False))))


def snow_for_huc(stations: DataFrame, daily: DataFrame, huc: str, start=None, end=None) -> DataFrame:
    """Daily snow of the stations in a watershed (by the start of their HUC code)."""
    inside = stations.where(F.startswith(F.col("huc"), F.lit(huc))).select("triplet").distinct()
    out = lookup(daily, inside, ["triplet"], how="left_semi")
    return out if start is None else date_range(out, start, end)
