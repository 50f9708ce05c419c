"""Join helpers shared by the operators: keys that hold very many rows are split, all others are left alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.numeric import col

#: Rows of one key that a task takes; keys with more are split into as many pieces as this goes into them.
HOT_ROWS = 1_000_000
#: Keys that a sketch names, and keys that it counts to find them.  Of keys that it misses, none has more than
#: a ``_COUNTED``-th of the rows; the runtime splits what is left of skew.
NAMED, _COUNTED = 64, 4096
#: Rows that one task may take however dear they are.
_FEW_ROWS = 10_000
#: How joins look for hot keys: ``None`` by a sketch of the keys, a number to split every key into so many pieces
#: (1: none), or the pieces themselves as found by :func:`hot_keys`.
Salts = int | Mapping[int, int] | None
SALTS: Salts = None


def _hash(keys: Sequence[Column]) -> Column:
    return F.xxhash64(*keys)


def _sketched(df: DataFrame, keys: Sequence[str | Column], rows: int | None) -> tuple[dict[int, int], int, int]:
    """The pieces of hot keys, the number of rows, and how many tasks had them."""
    rows = rows or HOT_ROWS
    hashed = df.select(_hash([col(k) if isinstance(k, str) else k for k in keys]).alias("h"), F.spark_partition_id().alias("p"))
    found = hashed.agg(F.call_function("approx_top_k", F.col("h"), F.lit(NAMED), F.lit(_COUNTED)).alias("top"),
                       F.count(F.lit(1)).alias("n"), F.approx_count_distinct("p").alias("tasks")).first()
    return {r["item"]: -(-r["count"] // rows) for r in found.top or () if r["count"] > rows}, found.n, found.tasks


def hot_keys(df: DataFrame, keys: Sequence[str | Column], rows: int | None = None) -> dict[int, int]:
    """Hash of every key with more than ``rows`` rows, and the pieces it is to be split into.

    One pass over the key columns, each task sketching what it reads; a result
    of at most ``NAMED`` numbers.  Runs the plan of ``df``.
    """
    return _sketched(df, keys, rows)[0]


def _pieces(hashed: Column, found: Mapping[int, int]) -> Column:
    table = F.create_map(*[F.lit(v).cast("long") for kv in found.items() for v in kv])
    return F.coalesce(F.try_element_at(table, hashed), F.lit(1).cast("long"))


def _spread(left: DataFrame, right: DataFrame, left_keys: Sequence[Column], right_keys: Sequence[Column], salts: Salts,
            rows: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with ``_salt`` and ``_rsalt``: hot keys' rows dealt over their pieces, the other side's repeated for each; None without any."""
    found = hot_keys(left, left_keys, rows) if salts is None else salts
    if not found or found == 1:
        return None
    if isinstance(found, int):
        of_left = of_right = F.lit(found).cast("long")
    else:
        of_left, of_right = _pieces(_hash(left_keys), found), _pieces(_hash(right_keys), found)
    dealt = F.pmod(F.xxhash64(*[col(c) for c in left.columns]), of_left)
    return left.withColumn("_salt", dealt), right.withColumn("_rsalt", F.explode(F.sequence(F.lit(0).cast("long"), of_right - 1)))


def lookup(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left", salts: Salts = SALTS) -> DataFrame:
    """Join one row per key onto many rows, with no task holding a whole hot key.

    Rows of a hot key are dealt over pieces, and the key's row is repeated for
    each; other keys are joined as they are, so a flat table has no salt in its
    plan.  When the runtime size of ``per_key`` is under the broadcast threshold
    Spark drops the shuffle instead.  NULL keys match NULL keys.
    """
    renamed = {k: f"_k{i}" for i, k in enumerate(keys)}
    right = per_key.withColumnsRenamed(renamed)
    spread = _spread(df, right, [col(k) for k in keys], [col(r) for r in renamed.values()], salts)
    conds: list[Column] = [col(k).eqNullSafe(col(r)) for k, r in renamed.items()]
    if spread is not None:
        df, right = spread
        conds.append(F.col("_salt") == F.col("_rsalt"))
    joined = df.join(right, reduce(lambda a, b: a & b, conds), how)
    return joined.drop("_salt", "_rsalt", *renamed.values())


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: Salts = SALTS, rows: int | None = None,
              dear: bool = False) -> DataFrame:
    """Inner join on columns of the same names, hot keys of ``left`` split; NULL keys match nothing.

    ``dear`` says that much work follows on every pair: if ``left`` comes in
    fewer tasks than the cluster runs at once, its rows are dealt out first.
    """
    if dear and salts is None:
        salts, n, tasks = _sketched(left, keys, rows)
        cores = left.sparkSession.sparkContext.defaultParallelism
        if tasks < cores and n > _FEW_ROWS:
            left = left.repartition(cores)
    spread = _spread(left, right, [col(k) for k in keys], [col(k) for k in keys], salts, rows)
    if spread is None:
        return left.join(right, list(keys))
    left, right = spread
    return left.join(right.withColumnRenamed("_rsalt", "_salt"), [*keys, "_salt"]).drop("_salt")


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join of which neither side is to be sent to all tasks: for rows made of few others, which Spark takes to be as few as these."""
    return df.hint("merge")


#: Rows of each side that meet in one task by one key, where every pair of them may be looked at.
_MET_LEFT, _MET_RIGHT = 100_000, 20_000
#: Rows of the left side that such a task takes on average.
_MET_ROWS = 250_000


def met_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: Salts = SALTS) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Both sides for a join by hand, the key they meet by, and the number of tasks for it.

    Keys that are hot on either side are split: the rows of that side are dealt
    over pieces, the other side's are repeated for each.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    tasks, keys = 3 * cores, list(keys)
    hot: Salts = salts
    if salts is None:
        hot, n, _ = _sketched(left, keys, _MET_LEFT)
        tasks = max(tasks, -(-n // _MET_ROWS))
    by = [col(k) for k in keys]
    spread = _spread(left, right, by, by, hot)
    if spread is not None:
        left, right = spread[0].withColumnRenamed("_salt", "_dealt"), spread[1].withColumnRenamed("_rsalt", "_dealt")
        keys.append("_dealt")
    if salts is None:
        by = [col(k) for k in keys]
        spread = _spread(right, left, by, by, hot_keys(right, keys, _MET_RIGHT))
        if spread is not None:
            right, left = spread[0], spread[1].withColumnRenamed("_rsalt", "_salt")
            keys.append("_salt")
    return left, right, keys, tasks


def dealt_out(df: DataFrame) -> DataFrame:
    """The same rows, in as many tasks as the cluster runs at once, for dear work on each of them.

    A small file is read by a task or two, however dear what is made of its rows.
    Counts the rows; to be called while they are still narrow.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    seen = df.select(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("p").alias("tasks")).first()
    if seen.tasks >= 2 * cores or seen.n < cores:
        return df
    return df.repartition(max(3 * cores, -(-seen.n // _FEW_ROWS)))
