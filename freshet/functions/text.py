"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from freshet.functions.numeric import col


def normalize_name(c: Column) -> Column:
    """Lower case, slash to dash, blank to NULL."""
    return F.nullif(F.lower(F.replace(c, F.lit("/"), F.lit("-"))), F.lit(""))


def field_at(c: Column, sep: str, i: int) -> Column:
    """The i-th (0-based) field of a separated line, NULL when there are fewer."""
    return F.get(F.split(c, sep, -1), F.lit(i))


def strip_quotes(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit('"'), F.lit(""))


def with_prefix(c: Column, prefix: str) -> Column:
    """Put ``prefix`` in front unless it is there already."""
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def is_digits(c: Column) -> Column:
    return c.rlike(r"^[0-9]+$")


def is_decimal_text(c: Column) -> Column:
    """Unsigned digits with at most one point, as report readers accept values."""
    return c.rlike(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$")


def leading_letters(c: Column, n: int = 2) -> Column:
    """First ``n`` characters of the first word, upper-cased."""
    return F.upper(F.substring(F.get(F.split(F.trim(c), r"\s+"), F.lit(0)), 1, n))


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become NULL in every string column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.nullif(col(n), F.lit("")) for n in texts})
