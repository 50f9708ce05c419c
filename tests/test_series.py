"""Chunked series operators against pandas and against plain windows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import series


def _frame(seed=1, stations=(("a", 150), ("b", 1), ("c", 40), ("d", 9))):
    rng = random.Random(seed)
    rows = []
    for name, n in stations:
        d = dt.date(2020, 11, 20)
        for i in range(n):
            d += dt.timedelta(days=1 + (rng.random() < .2) * rng.randint(1, 40))
            lo = None if rng.random() < .3 or 20 < i < 45 or i < 9 else rng.uniform(0, 9)
            hi = None if name == "d" else rng.uniform(0, 9)
            rows.append((name, d, lo, hi))
    rng.shuffle(rows)
    return rows


SCHEMA = "station_id string, date date, tmin double, tmax double"


def _expected(rows, f):
    pdf = pd.DataFrame(rows, columns=["station_id", "date", "tmin", "tmax"]).sort_values(["station_id", "date"])
    pdf[["tmin", "tmax"]] = pdf[["tmin", "tmax"]].astype(float)
    parts = []
    for _, g in pdf.groupby("station_id"):
        g = g.copy()
        for c in ("tmin", "tmax"):
            g[c] = f(g[c])
        parts.append(g)
    return pd.concat(parts).reset_index(drop=True)


def _actual(df):
    return df.toPandas()[["station_id", "date", "tmin", "tmax"]].sort_values(["station_id", "date"]).reset_index(drop=True)


def _same(actual, expected):
    assert list(actual.station_id) == list(expected.station_id)
    assert list(actual.date) == list(expected.date)
    for c in ("tmin", "tmax"):
        np.testing.assert_allclose(actual[c].astype(float), expected[c], rtol=1e-12)


def test_numbering_is_the_row_position(spark):
    rows = _frame()
    got = series.number_rows(spark.createDataFrame(rows, SCHEMA), "station_id", "date").toPandas()
    got = got.sort_values(["station_id", "date"])
    for _, g in got.groupby("station_id"):
        assert list(g["_n"]) == list(range(len(g)))


@pytest.mark.parametrize("window,chunk", [(7, 8), (4, 8), (7, 4096), (1, 3), (5, 5)])
def test_rolling_mean_is_pandas(spark, window, chunk):
    rows = _frame()
    df = spark.createDataFrame(rows, SCHEMA)
    got = series.centered_rolling_mean(df, ["tmin", "tmax"], "station_id", "date", window, chunk_rows=chunk)
    _same(_actual(got), _expected(rows, lambda s: s.rolling(window, min_periods=1, center=True).mean()))


def test_rolling_mean_of_missing_only(spark):
    rows = _frame()
    got = series.centered_rolling_mean(spark.createDataFrame(rows, SCHEMA), ["tmin", "tmax"], "station_id", "date",
                                       only_missing=True, chunk_rows=10)
    _same(_actual(got), _expected(rows, lambda s: s.fillna(s.rolling(7, min_periods=1, center=True).mean())))


@pytest.mark.parametrize("chunk", [3, 16, 4096])
def test_fills_are_pandas(spark, chunk):
    rows = _frame(2)
    df = spark.createDataFrame(rows, SCHEMA)
    cols = ["tmin", "tmax"]
    _same(_actual(series.backward_fill(df, cols, "station_id", "date", chunk)), _expected(rows, lambda s: s.bfill()))
    _same(_actual(series.forward_fill(df, cols, "station_id", "date", chunk)), _expected(rows, lambda s: s.ffill()))


def test_smooth_is_pandas_and_keeps_an_empty_column_empty(spark):
    rows = _frame(3)
    got = _actual(series.smooth(spark.createDataFrame(rows, SCHEMA), ["tmin", "tmax"], "station_id", "date", chunk_rows=8))
    _same(got, _expected(rows, lambda s: s.rolling(7, min_periods=1, center=True).mean().bfill().ffill()))
    assert got[got.station_id == "d"].tmax.isna().all()


def test_frames_wider_than_chunks(spark):
    rows = _frame()
    got = series.centered_rolling_mean(spark.createDataFrame(rows, SCHEMA), ["tmin", "tmax"], "station_id", "date", window=41, chunk_rows=4)
    _same(_actual(got), _expected(rows, lambda s: s.rolling(41, min_periods=1, center=True).mean()))


def _daily(n, station="s"):
    return [(station, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i), float(i) + .5, i * 2., i * 3., i / 10) for i in range(n)]


W_SCHEMA = "station_id string, date date, min_flow double, max_flow double, tmin double, tmax double, date_normalized double"


@pytest.mark.parametrize("n,count", [(0, 0), (87, 0), (88, 1), (89, 2)])
def test_window_count(spark, n, count):
    assert series.sliding_windows(spark.createDataFrame(_daily(n), W_SCHEMA)).count() == count


def test_windows_stay_within_a_station_and_hold_the_right_rows(spark):
    rows = _daily(300, "a") + _daily(88, "b") + _daily(50, "c")
    random.Random(5).shuffle(rows)
    got = series.sliding_windows(spark.createDataFrame(rows, W_SCHEMA), chunk_rows=100).toPandas()
    assert got.groupby("station_id").size().to_dict() == {"a": 213, "b": 1}
    for r in got.itertuples():
        i = (r.start - dt.date(2020, 1, 1)).days
        assert (r.end - r.start).days == 87
        x, y = np.array([list(v) for v in r.x]), np.array([list(v) for v in r.y])
        assert x.shape == (74, 5) and y.shape == (14, 2)
        np.testing.assert_array_equal(x[:, 0], np.arange(i, i + 74))
        np.testing.assert_array_equal(y[:, 1], np.arange(i + 74, i + 88) + .5)


def test_random_split_is_reproducible_and_complete(spark):
    w = series.sliding_windows(spark.createDataFrame(_daily(400), W_SCHEMA)).select("station_id", "start", "end")
    train, test = series.split_windows(w, .2, seed=7)
    again = series.split_windows(w.repartition(5), .2, seed=7)[1]
    assert sorted(test.collect()) == sorted(again.collect())
    assert train.count() + test.count() == w.count() == 313
    assert .1 < test.count() / 313 < .3
    assert train.intersect(test).count() == 0


def test_time_split_leaves_out_windows_across_the_cutoff(spark):
    w = series.sliding_windows(spark.createDataFrame(_daily(400), W_SCHEMA))
    cut = F.lit(dt.date(2020, 8, 1))
    train, test = series.split_windows_by_time(w, cut)
    assert train.agg(F.max("end")).first()[0] < dt.date(2020, 8, 1) <= test.agg(F.min("start")).first()[0]
    assert train.count() + test.count() == 313 - 87


def test_densify_adds_the_missing_days(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 2, 27), 1.0), ("a", dt.date(2020, 3, 1), 2.0)], "station_id string, date date, v double")
    got = sorted(series.densify(df).collect())
    assert [r.date.day for r in got] == [27, 28, 29, 1] and got[1].v is None
