"""Row-based operators along a per-station daily series.

A plain window partitioned by station puts a station's whole series into one
task.  Here the series is first numbered without that, then cut into pieces of
``chunk_rows`` consecutive rows; each piece also gets the few neighbouring rows
its frames look at.  The results are those of the plain window, row for row.

Contract: ``order`` starts with a date (or timestamp) column, and (by, order)
identifies a row.  A piece of calendar then holds a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.numeric import col
from freshet.operators.staging import shared

CHUNK_ROWS = 4096


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _key(by: Sequence[str], part: Column) -> Column:
    """One key of the series and a part of it.

    As a struct it joins NULL to NULL with plain equality, so the join and the
    windows on it share one shuffle.
    """
    return F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(by)], part.alias("part"))


def _along(key: str, by: Sequence[str]):
    """Window over the parts of a series, in order."""
    return W.partitionBy(*[F.col(f"{key}.k{i}") for i in range(len(by))]).orderBy(f"{key}.part")


def number_rows(df: DataFrame, by, order, out: str = "_n", span: str = "month") -> DataFrame:
    """0-based position of each row in its series, without a whole-series window.

    Rows are counted per (series, calendar span), the counts are summed up along
    each series, and rows are numbered within their span on top of that.
    """
    by, order = _names(by), _names(order)
    start_of_span = F.coalesce(F.date_trunc(span, col(order[0]).cast("timestamp_ntz")).cast("date"),
                               F.lit("0001-01-01").cast("date"))
    keyed = df.withColumn("_key", _key(by, start_of_span))
    before = _along("_key", by).rowsBetween(W.unboundedPreceding, -1)
    starts = keyed.groupBy("_key").count().select(
        "_key", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    # (series, span) groups are bounded by the calendar, so they need no salt.
    within = W.partitionBy("_key").orderBy(*map(col, order))
    return (keyed.join(starts, "_key").withColumn(out, F.col("_start") + F.row_number().over(within) - 1)
                 .drop("_key", "_start"))


def with_halo(df: DataFrame, by: Sequence[str], before: int, after: int, chunk_rows: int = CHUNK_ROWS,
              n: str = "_n") -> DataFrame:
    """Cut a numbered series into chunks that overlap by the rows frames need.

    Adds ``_chunk``, the series and the chunk's number, and ``_own``; a row
    appears once as its chunk's own, and once more in the chunk on either side
    when that chunk's frames reach it.  A chunk has at least as many rows as a
    frame looks ahead or back.
    """
    home = F.floor(F.col(n) / chunk_rows)
    pos = F.col(n) % chunk_rows
    chunks = F.array_compact(F.array(
        home,
        F.when((pos < after) & (home > 0), home - 1),
        F.when(pos >= chunk_rows - before, home + 1)))
    return (df.withColumn("_c", F.explode(chunks))
              .withColumns({"_chunk": _key(by, F.col("_c")), "_own": F.col("_c") == home}).drop("_c"))


def _chunk_window(n: str = "_n"):
    return W.partitionBy("_chunk").orderBy(n)


def _roll(df: DataFrame, cols, window: int, by, chunk_rows: int, only_missing: bool) -> DataFrame:
    """Centred rolling mean of a numbered frame; keeps ``_n`` and ``_chunk``."""
    before, after = window // 2, window - 1 - window // 2
    chunk_rows = max(chunk_rows, before, after)  # so that a frame reaches the next chunk at most
    frame = _chunk_window().rowsBetween(-before, after)
    cut = with_halo(df, by, before, after, chunk_rows)

    def rolled(c: str) -> Column:
        mean = F.avg(col(c)).over(frame)
        return F.coalesce(col(c), mean) if only_missing else mean

    return cut.withColumns({c: rolled(c) for c in cols}).where("_own").drop("_own")


def _fill(df: DataFrame, cols, by, backward: bool, forward: bool) -> DataFrame:
    """Backward, then forward fill of a numbered, chunked frame.

    Each chunk is reduced to the first and last value it holds; those are carried
    along the chunks, and rows look in their own chunk first.  The frame is
    written to shared storage, so that what leads to it (numbering, halo, rolling
    window) runs once and both the chunks' values and the rows are read from there.
    """
    df = shared(df, "chunked")
    stats = []
    for i, c in enumerate(cols):
        has = col(c).isNotNull()
        stats += [F.min_by(col(c), F.when(has, F.col("_n"))).alias(f"_first{i}"),
                  F.max_by(col(c), F.when(has, F.col("_n"))).alias(f"_last{i}")]
    edges = df.groupBy("_chunk").agg(*stats)
    series = _along("_chunk", by)
    later = series.rowsBetween(1, W.unboundedFollowing)
    earlier = series.rowsBetween(W.unboundedPreceding, -1)
    carried = edges.select(
        "_chunk",
        *[F.first(f"_first{i}", True).over(later).alias(f"_next{i}") for i in range(len(cols))],
        *[F.last(f"_last{i}", True).over(earlier).alias(f"_prev{i}") for i in range(len(cols))])
    df = df.join(carried, "_chunk")
    ahead = _chunk_window().rowsBetween(0, W.unboundedFollowing)
    behind = _chunk_window().rowsBetween(W.unboundedPreceding, 0)
    out = {}
    for i, c in enumerate(cols):
        options = [col(c)]
        if backward:
            options += [F.first(col(c), True).over(ahead), F.col(f"_next{i}")]
        if forward:
            options += [F.last(col(c), True).over(behind), F.col(f"_prev{i}")]
        out[c] = F.coalesce(*options)
    spare = [f"_{side}{i}" for side in ("next", "prev") for i in range(len(cols))]
    return df.withColumns(out).drop(*spare)


def _chunked(df: DataFrame, by: Sequence[str], chunk_rows: int) -> DataFrame:
    return df.withColumn("_chunk", _key(by, F.floor(F.col("_n") / chunk_rows)))


def centered_rolling_mean(df: DataFrame, cols, by, order, window: int = 7,
                          only_missing: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean over ``window`` rows centred on each row, NULLs ignored.

    Replaces every value; with ``only_missing`` just the NULL ones.
    An even window looks one row further back than ahead.
    """
    by = _names(by)
    numbered = number_rows(df, by, order)
    return _roll(numbered, _names(cols), window, by, chunk_rows, only_missing).drop("_n", "_chunk")


def backward_fill(df: DataFrame, cols, by, order, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Replace NULLs by the next value of the series."""
    by = _names(by)
    numbered = _chunked(number_rows(df, by, order), by, chunk_rows)
    return _fill(numbered, _names(cols), by, True, False).drop("_n", "_chunk")


def forward_fill(df: DataFrame, cols, by, order, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Replace NULLs by the previous value of the series."""
    by = _names(by)
    numbered = _chunked(number_rows(df, by, order), by, chunk_rows)
    return _fill(numbered, _names(cols), by, False, True).drop("_n", "_chunk")


def smooth(df: DataFrame, cols, by, order, window: int = 7, only_missing: bool = False,
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rolling mean, then backward fill, then forward fill, numbering the rows once."""
    by, cols = _names(by), _names(cols)
    numbered = number_rows(df, by, order)
    rolled = _roll(numbered, cols, window, by, chunk_rows, only_missing)
    return _fill(rolled, cols, by, True, True).drop("_n", "_chunk")


def smooth_temperatures(df: DataFrame, by="station_id", order="date", window: int = 7,
                        only_missing: bool = False) -> DataFrame:
    return smooth(df, ["tmin", "tmax"], by, order, window, only_missing)


def densify(df: DataFrame, by="station_id", date: str = "date") -> DataFrame:
    """Add the missing days between each station's first and last day as NULL rows."""
    days = (df.groupBy(col(by)).agg(F.min(col(date)).alias("_a"), F.max(col(date)).alias("_b"))
              .select(col(by), F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date)))
    return days.join(df, [by, date], "left")


def sliding_windows(df: DataFrame, by="station_id", order="date", history: int = 60,
                    forecast: int = 14, horizon: int = 14,
                    features: Sequence[str] = ("min_flow", "max_flow", "tmin", "tmax", "date_normalized"),
                    targets: Sequence[str] = ("min_flow", "max_flow"),
                    chunk_rows: int = 256) -> DataFrame:
    """Stride-1 training windows of each station's series.

    ``x`` holds history + forecast rows of features, ``y`` the next ``horizon``
    rows of targets; a series of n rows gives n - (history + forecast + horizon) + 1.
    Columns that are constant for a station (its one-hot part) are not repeated
    in every row of ``x``; the key is kept, join them on it once.
    """
    by, order = _names(by), _names(order)
    seen, total = history + forecast, history + forecast + horizon
    chunk_rows = max(chunk_rows, total)
    cut = with_halo(number_rows(df, by, order), by, 0, total - 1, chunk_rows)
    row = F.struct(F.col("_n"), col(order[0]).alias("day"),
                   F.array(*[col(c).cast("double") for c in features]).alias("x"),
                   F.array(*[col(c).cast("double") for c in targets]).alias("y"))
    # At most chunk_rows + total - 1 rows per group.
    pieces = (cut.groupBy("_chunk")
                 .agg(F.sort_array(F.collect_list(row)).alias("_rows"),
                      F.count_if(F.col("_own")).alias("_own"))
                 .withColumn("_m", F.least(F.col("_own"), F.size("_rows") - F.lit(total - 1)))
                 .where("_m >= 1")
                 .select(*[F.col(f"_chunk.k{i}").alias(c) for i, c in enumerate(by)], "_m", F.col("_rows.day").alias("_days"),
                         F.col("_rows.x").alias("_xs"), F.col("_rows.y").alias("_ys")))
    windows = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("_m")),
        lambda i: F.struct(
            F.get(F.col("_days"), (i - 1).cast("int")).alias("start"),
            F.get(F.col("_days"), (i + (total - 2)).cast("int")).alias("end"),
            F.slice(F.col("_xs"), i.cast("int"), F.lit(seen)).alias("x"),
            F.slice(F.col("_ys"), (i + seen).cast("int"), F.lit(horizon)).alias("y")))
    return pieces.select(*map(col, by), F.inline(windows))


def split_windows(windows: DataFrame, test_fraction: float = 0.2, seed: int = 0,
                  by="station_id", start: str = "start") -> tuple[DataFrame, DataFrame]:
    """Random (train, test) split that a re-run task reproduces exactly.

    The draw is a hash of the window's key and the seed, not a generator whose
    output depends on row order.
    """
    key = F.xxhash64(F.lit(seed), *map(col, _names(by)), col(start))
    drawn = F.pmod(key, F.lit(1 << 30)) < int(test_fraction * (1 << 30))
    return windows.where(~drawn), windows.where(drawn)


def split_windows_by_time(windows: DataFrame, cutoff: Column, start: str = "start",
                          end: str = "end") -> tuple[DataFrame, DataFrame]:
    """Train on windows that end before ``cutoff``, test on those starting from it.

    Stride-1 windows overlap, so windows across the cut-off belong to neither.
    """
    return windows.where(col(end) < cutoff), windows.where(col(start) >= cutoff)
