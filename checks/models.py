"""The forecaster, and what the writers leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query
from checks.core import DAILY
from freshet.operators import flows
from freshet.operators.staging import new_folder
from freshet.plans import forecast
from freshet.sources import sinks

# --- a linear rule, found again -------------------------------------------------------------

# Two rows of two numbers, and what follows from them and the station; the offset keeps results off rounding limits.
_WINDOW_SQL = """w AS (SELECT o_orderkey AS k, o_custkey % 40 AS s, o_totalprice / 1e5 AS a, (o_orderkey % 97) / 97e0 AS b, (o_custkey % 89) / 89e0 AS c, dayofyear(o_orderdate) / 366e0 AS d FROM orders),
y AS (SELECT k, a / 2 - b + 3 * c + s / 8e0 AS lo1, b + d / 4 - s / 4e0 AS hi1, 2 * d - a AS lo2, 5 - c + s * s / 64e0 AS hi2 FROM w)"""
_SHIFT = "0.001234567891e0"
_TARGETS = {"lo_day1": "lo1", "hi_day1": "hi1", "lo_day2": "lo2", "hi_day2": "hi2"}


def _rule_windows(t):
    s = F.col("o_custkey") % 40
    a, b = F.col("o_totalprice") / 1e5, (F.col("o_orderkey") % 97) / 97.0
    c, d = (F.col("o_custkey") % 89) / 89.0, F.dayofyear("o_orderdate") / 366.0
    x = F.array(F.array(a, b), F.array(c, d))
    y = F.array(F.array(a / 2 - b + 3 * c + s / 8.0, b + d / 4 - s / 4.0), F.array(2 * d - a, 5 - c + s * s / 64.0))
    return t.orders.select("o_orderkey", s.cast("string").alias("station_id"), x.alias("x"), y.alias("y"))


def _rule_model(t):
    windows = _rule_windows(t)
    split = windows.where("o_orderkey % 5 <> 0"), windows.where("o_orderkey % 5 = 0")
    return forecast.fit_forecaster(windows, 2, ("lo", "hi"), split=split), split[1]


def _shown(predicted):
    return predicted.select("o_orderkey", *[F.round(F.col(n) + 0.001234567891, 2).alias(n) for n in _TARGETS])


_RULE_SQL = f"WITH {_WINDOW_SQL} SELECT k AS o_orderkey, {', '.join(f'round({y} + {_SHIFT}, 2) AS {n}' for n, y in _TARGETS.items())} FROM y WHERE k % 5 = 0"


@query("fit_forecaster_rule", _RULE_SQL)
def _(t):
    """Predictions for windows that took no part in the fit."""
    model, test = _rule_model(t)
    return _shown(model.predict(test))


@query("fit_forecaster_errors", "SELECT unnest(['lo_day1', 'hi_day1', 'lo_day2', 'hi_day2']) AS target, 0e0 AS mse")
def _(t):
    model, _ = _rule_model(t)
    return t.spark.createDataFrame(sorted(model.scores.items()), "target string, mse double").withColumn("mse", F.round("mse", 9))


@query("save_forecaster", _RULE_SQL)
def _(t):
    """The same from the model written and read again."""
    model, test = _rule_model(t)
    path = new_folder(t.spark, "model")
    model.save(path)
    return _shown(forecast.load_forecaster(t.spark, path).predict(test))


# --- tables written, written over in part, and read again --------------------------------------------

_PART_SQL = f"""WITH d AS ({DAILY}), again AS (SELECT * FROM d WHERE CAST(station_id AS BIGINT) % 5 = 0 AND date < '2024-01-20')
SELECT * FROM d WHERE CAST(station_id AS BIGINT) % 5 <> 0 OR station_id NOT IN (SELECT station_id FROM again)
UNION ALL SELECT station_id, date, min_flow + 1, max_flow + 1 FROM again"""


def _write_and_replace(t, fmt):
    daily = flows.daily_extremes(t.readings()).select("station_id", "date", "min_flow", "max_flow")
    path = new_folder(t.spark, "combined")
    sinks.write_combined(daily, path, fmt, buckets=8)
    again = daily.where("CAST(station_id AS BIGINT) % 5 = 0 AND date < '2024-01-20'").withColumns(
        {"min_flow": F.col("min_flow") + 1, "max_flow": F.col("max_flow") + 1})
    sinks.write_combined(again, path, fmt, "stations", buckets=8)
    return sinks.read_combined(t.spark, path, daily.schema, fmt)


@query("write_combined", _PART_SQL)
def _(t):
    """A run of some stations replaces what was there of them and nothing else."""
    return _write_and_replace(t, "parquet")


@query("write_combined_csv", _PART_SQL)
def _(t):
    return _write_and_replace(t, "csv")


@query("write_normalized", "SELECT event_id, value, event_type, event_id % 2 = 0 AS station_a FROM events")
def _(t):
    rows = t.events.select("event_id", "value", "event_type", (F.col("event_id") % 2 == 0).alias("station_a"))
    path = new_folder(t.spark, "normalized")
    sinks.write_normalized(rows, path, "csv")
    return sinks.read_normalized(t.spark, path, rows.schema, "csv")
