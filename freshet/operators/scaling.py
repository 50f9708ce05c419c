"""Whole-column statistics: filling, standardising, one-hot encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.numeric import col
from freshet.operators.joins import HOT_ROWS, NAMED, lookup
from freshet.operators.staging import shared


def _single(df: DataFrame, stats: dict[str, Column]) -> Column:
    """Whole-table aggregates as one scalar subquery: no unpartitioned window, no cross join."""
    return df.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s")).scalar()


def fill_mean(df: DataFrame, cols: Sequence[str], by: str | Sequence[str] | None = None) -> DataFrame:
    """Replace NULLs by the column mean, of the group when ``by`` is given.

    A column without any value stays NULL.  Groups large enough to be split are
    known from their means' counts.
    """
    if by is None:
        means = _single(df, {f"m{i}": F.avg(col(c)) for i, c in enumerate(cols)})
        return df.withColumns({c: F.coalesce(col(c), means[f"m{i}"]) for i, c in enumerate(cols)})
    by = [by] if isinstance(by, str) else list(by)
    means = shared(df.groupBy(*map(col, by)).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(col(c)).alias(f"_m{i}") for i, c in enumerate(cols)]), "means")
    large = means.where(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n")).limit(NAMED)
    pieces = {r.h: -(-r.n // HOT_ROWS) for r in large.select(F.xxhash64(*map(col, by)).alias("h"), F.col("_n").alias("n")).collect()}
    filled = {c: F.coalesce(col(c), F.col(f"_m{i}")) for i, c in enumerate(cols)}
    return (lookup(df, means.drop("_n"), by, salts=pieces).withColumns(filled)
            .drop(*[f"_m{i}" for i in range(len(cols))]))


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(value - mean) / population deviation; a constant column is only centred."""
    stats = {}
    for i, c in enumerate(cols):
        stats[f"m{i}"], stats[f"s{i}"] = F.avg(col(c)), F.stddev_pop(col(c))
    s = _single(df, stats)
    return df.withColumns({
        c: (col(c) - s[f"m{i}"]) / F.when(s[f"s{i}"] == 0, F.lit(1.0)).otherwise(s[f"s{i}"])
        for i, c in enumerate(cols)})


def fill_and_standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``fill_mean`` over the whole table, then ``standardize``, from one look at the data.

    Filling with the mean leaves the mean as it is and shrinks the variance by the
    share of values that were there, so both steps need the same statistics.
    """
    stats = {"n": F.count(F.lit(1))}
    for i, c in enumerate(cols):
        stats[f"m{i}"], stats[f"s{i}"], stats[f"n{i}"] = F.avg(col(c)), F.stddev_pop(col(c)), F.count(col(c))
    s = _single(df, stats)

    def scaled(i: int, c: str) -> Column:
        deviation = s[f"s{i}"] * F.sqrt(s[f"n{i}"] / s["n"])
        return (F.coalesce(col(c), s[f"m{i}"]) - s[f"m{i}"]) / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)

    return df.withColumns({c: scaled(i, c) for i, c in enumerate(cols)})


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column)).where(col(column).isNotNull()).distinct()


def one_hot(df: DataFrame, column: str, prefix: str, values: Sequence, drop: bool = True) -> DataFrame:
    """One boolean column ``<prefix>_<value>`` for each of ``values``, sorted, at the end.

    NULL is false everywhere.  The columns are part of the schema, so the caller
    says which there are; for a domain that comes from the data take
    ``one_hot_index``.
    """
    flags = {f"{prefix}_{v}": F.coalesce(col(column) == F.lit(v), F.lit(False)) for v in sorted(values)}
    out = df.withColumns(flags) if flags else df
    return out.drop(column) if drop else out


def one_hot_index(df: DataFrame, column: str, out: str) -> DataFrame:
    """Position of the single 1 in a one-hot vector, for domains too wide for columns.

    Values are numbered 0..n-1 in hash-bucket order, so neither the driver nor
    one task ever holds the domain.  NULL has no position.
    """
    values = distinct_values(df, column).withColumn("_b", F.pmod(F.xxhash64(col(column)), F.lit(1024)))
    sizes = values.groupBy("_b").count()
    offsets = sizes.select("_b", F.coalesce(F.sum("count").over(  # 1024 rows
        W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = values.join(offsets, "_b").select(
        col(column), (F.col("_o") + F.row_number().over(
            W.partitionBy("_b").orderBy(col(column))) - 1).alias(out))
    return lookup(df, numbered, [column])
