"""A linear flow forecaster on the training windows."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.numeric import col
from freshet.operators.joins import lookup
from freshet.operators.series import sliding_windows, split_windows
from freshet.operators.staging import shared
from freshet.plans.dataset import normalize
from freshet.sources.sinks import read_model, save_model

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SUMS = "kind int, row long, station string, n long, v array<double>"


@dataclass(frozen=True)
class Forecaster:
    """Weights of every (day ahead, target), a level for each station, and the hold-out errors.

    ``weights`` has a row for each number of a window and a column for each
    target; ``levels`` is (station, level), ``level`` with a number per target.
    """

    names: tuple[str, ...]
    weights: np.ndarray
    levels: DataFrame
    scores: dict[str, float]

    def predict(self, windows: DataFrame, station: str = "station_id") -> DataFrame:
        """The windows with a column for each target; NULL where a window has a NULL, no level for a station not seen in training."""
        weights, width = self.weights, len(self.names)

        @F.pandas_udf("array<double>")
        def times_weights(x: pd.Series) -> pd.Series:
            good = np.array([v is not None and len(v) == len(weights) for v in x])
            out = np.full((len(x), width), np.nan)
            if good.any():
                out[good] = np.stack([np.asarray(v, float) for v, g in zip(x, good) if g]) @ weights
            return pd.Series(list(out))

        known = self.levels.select(F.col("station").alias("_station"), F.col("level").alias("_level"))
        # The key has a name of its own, whatever the windows call theirs.
        rows = lookup(windows.withColumn("_station", col(station).cast("string")), known, ["_station"])
        product = rows.withColumn("_p", times_weights(F.flatten("x")))
        level = F.coalesce("_level", F.array_repeat(F.lit(0.0), width))
        out = product.withColumns({n: F.nanvl(F.get("_p", F.lit(i)), F.lit(None)) + F.get(level, F.lit(i)) for i, n in enumerate(self.names)})
        return out.drop("_p", "_station", "_level")

    def save(self, path: str) -> None:
        spark = self.levels.sparkSession
        rows = [(i, n, self.scores.get(n), [float(w) for w in self.weights[:, i]]) for i, n in enumerate(self.names)]
        save_model({"targets": spark.createDataFrame(rows, "i int, target string, mse double, weights array<double>"),
                    "levels": self.levels}, path)


def load_forecaster(spark: SparkSession, path: str) -> Forecaster:
    tables = read_model(spark, path, {"targets": "i int, target string, mse double, weights array<double>",
                                      "levels": "station string, level array<double>"})
    targets = sorted(tables["targets"].collect())
    return Forecaster(tuple(r.target for r in targets), np.array([r.weights for r in targets]).T, tables["levels"],
                      {r.target: r.mse for r in targets if r.mse is not None})


def _complete(windows: DataFrame, station: str, horizon: int, n_targets: int) -> DataFrame:
    """(station, z): a window's numbers and then its targets, of windows without a gap."""
    y = F.flatten(F.slice("y", 1, horizon))
    z = F.concat(F.flatten("x"), y)
    whole = (F.size(y) == horizon * n_targets) & ~F.exists(z, lambda v: v.isNull() | F.isnan(v))
    return windows.where(whole).select(col(station).cast("string").alias("station"), z.alias("z"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows (station, n, z): the sum of zz' row by row, and each station's count and sum of z.

    The product is summed over the whole partition; station sums leave with every
    batch, so a task holds no more than a batch and one square matrix.
    """
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        total = z.T @ z if total is None else total + z.T @ z
        station, at = np.unique(np.array(["" if s is None else "s" + s for s in batch.column("station").to_pylist()]), return_inverse=True)
        sums = np.zeros((len(station), z.shape[1]))
        np.add.at(sums, at, z)
        yield _batch(1, np.zeros(len(station), np.int64), [s[1:] if s else None for s in station.tolist()],
                     np.bincount(at, minlength=len(station)), sums)
    if total is not None:
        k = len(total)
        yield _batch(0, np.arange(k), [None] * k, np.zeros(k, np.int64), total)


def _batch(kind: int, row: np.ndarray, station: list, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(v), kind), pa.int32()), pa.array(row, pa.int64()), pa.array(station, pa.string()), pa.array(n, pa.int64()),
         pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), pa.float64()))], ["kind", "row", "station", "n", "v"])


def _summed(rows: DataFrame) -> DataFrame:
    total = vector_to_array(Summarizer.sum(array_to_vector("v")))
    return rows.groupBy("kind", "row", "station").agg(F.sum("n").alias("n"), total.alias("v"))


def _matrix(sums: DataFrame) -> np.ndarray:
    """The summed product; as large as the square of a window's numbers and targets, whatever the rows."""
    return np.array([r.v for r in sums.where("kind = 0").orderBy("row").select("v").collect()])


def fit_forecaster(windows: DataFrame, horizon: int, targets: Sequence[str] = ("min_flow", "max_flow"),
                   station: str = "station_id", test_fraction: float = 0.2, seed: int = 0,
                   reg_param: float = 0.0, split: tuple[DataFrame, DataFrame] | None = None) -> Forecaster:
    """Least squares for all days ahead and targets at once; mean squared error on the held-out windows.

    Every station has a level of its own, which stands in for an intercept.  One
    pass over the training windows sums their products and each station's sums;
    the levels are taken out of the normal equations by the station sums, so the
    matrix solved is as wide as a window, for any number of stations.
    ``reg_param`` times the number of windows is added to the diagonal; without
    it, weights that the data leave open are the smallest ones.

    Windows with a NULL among their numbers or targets are left out.  ``split``
    gives (train, test) windows instead of the seeded random split.
    """
    train, test = split or split_windows(windows, test_fraction, seed, station)
    names = tuple(f"{t}_day{d + 1}" for d in range(horizon) for t in targets)
    rows = _complete(train, station, horizon, len(targets))
    sums = shared(_summed(rows.mapInArrow(_products, _SUMS)), "sums")
    product, stations = _matrix(sums), sums.where("kind = 1").select("station", "n", "v")
    if not len(product):
        raise ValueError("no complete window to train on")
    n = stations.agg(F.sum("n")).first()[0]
    width, ridge = len(product) - len(names), reg_param * n
    within = stations.select("station", F.transform("v", lambda v: v / F.sqrt(F.col("n") + ridge)).alias("z"))
    # zz' of the sums over the root of the counts: what the stations' levels explain.
    left = product - _matrix(_summed(within.mapInArrow(_products, _SUMS).where("kind = 0")))
    weights = _solve(left[:width, :width] + ridge * np.eye(width), left[:width, width:])
    levels = shared(stations.select("station", "n", _levels(weights)(F.col("v"), F.col("n") + ridge).alias("level"))
                    .select("station", "level"), "levels")
    model = Forecaster(names, weights, levels, {})
    model.scores.update(holdout_errors(model, test, station, horizon, len(targets)))
    return model


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least solution of a symmetric system, numbers scaled alike."""
    scale = 1 / np.sqrt(np.maximum(np.diag(a), np.finfo(float).tiny))
    scale[np.diag(a) <= 1e-12 * max(float(np.diag(a).max(initial=0)), 0)] = 0
    values, vectors = np.linalg.eigh(a * scale[:, None] * scale[None, :])
    good = values > 1e-11 * max(float(values.max(initial=0)), 0)
    v = vectors[:, good]
    return scale[:, None] * (v @ ((v.T @ (b * scale[:, None])) / values[good][:, None]))


def _levels(weights: np.ndarray):
    """A station's level: what its targets' mean is above the weighted mean of its numbers."""
    width = len(weights)

    @F.pandas_udf("array<double>")
    def level(v: pd.Series, n: pd.Series) -> pd.Series:
        v = np.stack(v.to_list()) if len(v) else np.zeros((0, width + weights.shape[1]))
        return pd.Series(list((v[:, width:] - v[:, :width] @ weights) / n.to_numpy(float)[:, None]))
    return level


def holdout_errors(model: Forecaster, windows: DataFrame, station: str, horizon: int, n_targets: int) -> dict[str, float]:
    """Mean squared error of every target over windows that have it; a target that no window has is left out."""
    y = F.flatten(F.slice("y", 1, horizon))
    kept = windows.select(col(station).alias("_key"), "x", y.alias("_y")).where(F.size("_y") == horizon * n_targets)
    predicted = model.predict(kept, "_key")
    errors = predicted.agg(*[_mse(F.col(n), F.get("_y", F.lit(i))).alias(n) for i, n in enumerate(model.names)]).first()
    return {n: errors[n] for n in model.names if errors[n] is not None}


def _mse(a: Column, b: Column) -> Column:
    return F.avg(F.pow(a - b, 2))


def train_forecaster(combined: DataFrame, history: int = 60, forecast: int = 14, horizon: int = 14, window: int = 7,
                     test_fraction: float = 0.2, seed: int = 0, reg_param: float = 0.0, path: str | None = None) -> Forecaster:
    """From the combined table to a fitted forecaster: normalise, cut windows, split, fit, and save if a path is given."""
    features = normalize(combined, window, keep_keys=True)
    windows = sliding_windows(features, "station_id", "date", history, forecast, horizon)
    model = fit_forecaster(windows, horizon, test_fraction=test_fraction, seed=seed, reg_param=reg_param)
    if path is not None:
        model.save(path)
    return model
