"""Date expressions.  Nothing here reads the clock: ``as_of`` is always passed in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"


def is_leap(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366


def year_fraction(d: Column) -> Column:
    """Position in the year, Jan 1 = 0, always below 1."""
    days = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))
    return (F.dayofyear(d) - 1) / days


def extract_timestamp(text: Column) -> Column:
    """The first ``yyyy-MM-dd HH:mm:ss`` inside the text, else NULL."""
    return F.regexp_substr(text, F.lit(_STAMP)).try_cast("timestamp_ntz")


def lenient_date(c: Column) -> Column:
    """Date of a value that may not be one; bad input is NULL."""
    return c.try_cast("date")


def strict_date(c: Column) -> Column:
    """``yyyy-MM-dd`` or an error: for sources whose dates must be good."""
    return F.to_date(c, "yyyy-MM-dd")


def lookback(as_of: Column, days: int, lag: int = 0) -> tuple[Column, Column]:
    """(start, end) of the ``days`` long range that ends ``lag`` days before ``as_of``."""
    return F.date_sub(as_of, days + lag), F.date_sub(as_of, lag)


def date_series(start: Column, end: Column) -> Column:
    """Every day from start to end (both in), as an array to explode."""
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))) \
        .otherwise(F.array().cast("array<date>"))
