"""Scaling, merging and the end-to-end jobs."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import nested, numeric, rings
from freshet.operators import filters, flows, scaling, series, simplify
from freshet.plans import dataset, forecast, watershed

COMBINED = "station_id string, date date, tmin double, tmax double, min_flow double, max_flow double"


def test_fill_leaves_the_mean_and_an_empty_column(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("a", 4.0, None), ("b", None, 2.0), (None, None, 3.0), (None, 5.0, None)], "k string, u double, v double")
    got = {(r.k, r.u, r.v) for r in scaling.fill_mean(df, ["u", "v"], "k").collect()}
    assert got == {("a", 1.0, None), ("a", 2.5, None), ("a", 4.0, None), ("b", None, 2.0), (None, 5.0, 3.0)}
    whole = scaling.fill_mean(df, ["u"])
    assert abs(whole.agg(F.avg("u")).first()[0] - 10 / 3) < 1e-12


def test_standardize_is_population_and_survives_a_constant(spark):
    values = [1.0, 2.0, 4.0, 9.0, None]
    df = spark.createDataFrame([(v, 3.0) for v in values], "v double, c double")
    got = scaling.standardize(df, ["v", "c"]).toPandas()
    v = np.array(values[:-1])
    np.testing.assert_allclose(got.v[:-1], (v - v.mean()) / v.std())
    assert set(got.c) == {0.0}
    filled = scaling.fill_and_standardize(df, ["v", "c"]).toPandas()
    f = np.array(values[:-1] + [v.mean()])
    np.testing.assert_allclose(filled.v, (f - f.mean()) / f.std(), atol=1e-12)


def test_one_hot_is_get_dummies(spark):
    data = ["b:2", "a", None, "c", "a"]
    got = scaling.one_hot(spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, s string"), "s", "station", ["b:2", "c", "a"]).orderBy("i").toPandas()
    want = pd.get_dummies(pd.DataFrame({"i": range(5), "s": data}), columns=["s"], prefix=["station"])
    assert list(got.columns) == list(want.columns)
    assert (got.values == want.values).all()


def test_merge_multiplies_duplicates_and_fills_per_station(spark):
    d = dt.date(2024, 1, 1)
    wx = spark.createDataFrame([("a", d, 1.0), ("a", d, 3.0), ("b", d, 7.0)], "station_id string, date date, tmin double")
    fl = spark.createDataFrame([("a", d, 10.0), ("a", d, 20.0), ("a", dt.date(2024, 1, 2), 30.0)], "station_id string, date date, min_flow double")
    got = sorted((r.station_id, r.date.day, r.tmin, r.min_flow) for r in flows.merge_weather_flow(wx, fl).where("station_id = 'a'").collect())
    assert got == [("a", 1, 1.0, 10.0), ("a", 1, 1.0, 20.0), ("a", 1, 3.0, 10.0), ("a", 1, 3.0, 20.0), ("a", 2, 2.0, 30.0)]
    with pytest.raises(ValueError):
        flows.merge_weather_flow(wx.drop("date"), fl)


def test_normalize_is_the_pandas_recipe(spark):
    rng = random.Random(4)
    data = [(s, dt.date(2023, 12, 1) + dt.timedelta(days=i), *[None if rng.random() < .2 else rng.uniform(0, 9) for _ in range(4)]) for s in ("a", "b:1") for i in range(60)]
    pdf = pd.DataFrame(data, columns=["station_id", "date", "tmin", "tmax", "min_flow", "max_flow"])
    got = dataset.normalize(spark.createDataFrame(data, COMBINED), station_values=["a", "b:1"], keep_keys=True).toPandas().sort_values(["station_id", "date"]).reset_index(drop=True)
    for c in ("tmin", "tmax"):
        pdf[c] = pdf.groupby("station_id")[c].transform(lambda s: s.rolling(7, min_periods=1, center=True).mean().bfill().ffill())
    for c in ("tmin", "tmax", "min_flow", "max_flow"):
        pdf[c] = pdf[c].fillna(pdf[c].mean())
        pdf[c] = (pdf[c] - pdf[c].mean()) / pdf[c].std(ddof=0)
        np.testing.assert_allclose(got[c], pdf[c], atol=1e-9)
    day = pd.to_datetime(pdf.date)
    np.testing.assert_allclose(got.date_normalized, (day.dt.dayofyear - 1) / (365 + day.dt.is_leap_year))
    assert filters.prefixed_columns(spark.createDataFrame(got.head(1))) == ["station_id", "station_a", "station_b:1"]
    by_index = dataset.normalize(spark.createDataFrame(data, COMBINED))
    assert by_index.columns == ["tmin", "tmax", "min_flow", "max_flow", "station_index", "date_normalized"]
    plain = dataset.normalize(spark.createDataFrame(data, COMBINED), station_values=["a", "b:1"])
    assert plain.columns == ["tmin", "tmax", "min_flow", "max_flow", "station_a", "station_b:1", "date_normalized"]


def test_build_dataset_goes_on_past_bad_sites(spark):
    day0 = dt.date(2024, 1, 1)

    def days(n):
        return [day0 + dt.timedelta(days=i) for i in range(n)]

    src = dataset.Sources(
        sites=spark.createDataFrame([("USGS:1",), ("DWR:X",), ("USGS:far",), ("USGS:dry",), ("USGS:lost",), ("EPA:9",), ("nonsense",)], "value string"),
        coordinates=spark.createDataFrame([("USGS", "1", 40.0, -105.0), ("DWR", "X", 40.1, -105.0), ("USGS", "dry", 40.0, -105.0)], "prefix string, site_id string, lat double, lon double"),
        readings=spark.createDataFrame([(p, s, dt.datetime(d.year, d.month, d.day, h), v) for p, s in (("USGS", "1"), ("DWR", "X"), ("USGS", "far"), ("EPA", "9")) for d in days(3) for h, v in ((1, 5.0), (2, 8.0))],
                                       "prefix string, station_id string, ts timestamp_ntz, flow double"),
        wx_stations=spark.createDataFrame([("USW00000001", 40.0, -105.0)], "wx_id string, lat double, lon double"),
        wx_meta=spark.createDataFrame([("GHCND:USW00000001", .95, dt.date(1990, 1, 1), dt.date(2024, 6, 1))], "wx_id string, datacoverage double, mindate date, maxdate date"),
        wx_fields=spark.createDataFrame([("USW00000001", "TMIN"), ("USW00000001", "TMAX")], "wx_id string, datatype string"),
        wx_daily=spark.createDataFrame([("USW00000001", d, 1.0, None) for d in days(5)], "noaa_station string, date date, tmin double, tmax double"))
    combined, rejects = dataset.build_dataset(src, "2024-03-01")
    got = combined.orderBy("station_id", "date").collect()
    assert [(r.station_id, r.date.day) for r in got] == [(s, i) for s in ("DWR:X", "USGS:1") for i in range(1, 6)]
    assert [(r.min_flow, r.max_flow, r.tmin, r.tmax) for r in got[:5]] == [(5.0, 8.0, 1.0, None)] * 5
    assert {(r.station_id, r.reason) for r in rejects.collect()} == {
        ("EPA:9", "unknown prefix"), ("nonsense", "unknown prefix"), ("USGS:far", "no weather"), ("USGS:dry", "no flow"), ("USGS:lost", "no data")}


def test_forecaster_finds_a_linear_rule_and_can_be_saved(spark, landing):
    # A sine is a linear recurrence of its last two values; v adds the station's level.
    days = spark.range(120).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.sin(F.col("id") * 1.0).alias("u"))
    shifted = (days.withColumns({"station_id": F.lit("a"), "v": F.col("u")})
               .unionByName(days.withColumns({"station_id": F.lit("b"), "v": F.col("u") + 5.0})))
    w = series.sliding_windows(shifted, history=3, forecast=1, horizon=2, features=["u"], targets=["u", "v"])
    fit = forecast.fit_forecaster(w, horizon=2, targets=("u", "v"))
    assert set(fit.scores) == {"u_day1", "v_day1", "u_day2", "v_day2"} and max(fit.scores.values()) < 1e-6
    fit.save(f"{landing}/model")
    again = forecast.load_forecaster(spark, f"{landing}/model")
    assert again.names == fit.names and again.scores == fit.scores
    w = w.withColumns({"station": F.lit("clash"), "level": F.lit(1), "n": F.lit(1)})
    off = again.predict(w).select(*[F.max(F.abs(F.col(f"{t}_day{d + 1}") - F.get(F.get("y", F.lit(d)), F.lit(i))))
                                    for d in (0, 1) for i, t in enumerate(("u", "v"))]).first()
    assert max(off) < 1e-6 and again.predict(w).columns == [*w.columns, *fit.names]
    strange = w.limit(2).withColumn("station_id", F.when(F.col("start") < "2000-01-01", "c"))
    assert all(r.u_day1 is not None for r in again.predict(strange).collect())


def test_forecaster_with_gaps_ridge_and_few_rows(spark):
    rng = np.random.default_rng(1)
    x, level = rng.normal(size=(300, 2, 3)), {"a": 2.0, "b": -1.0, None: 0.5}
    keys = [list(level)[i % 3] for i in range(300)]
    weights = rng.normal(size=(6, 2))
    y = x.reshape(300, 6) @ weights + np.array([level[k] for k in keys])[:, None]
    rows = [(k, [[float(v) for v in r] for r in a], [[float(v) for v in b]]) for k, a, b in zip(keys, x, y)]
    schema = "station_id string, x array<array<double>>, y array<array<double>>"
    whole = spark.createDataFrame(rows, schema).repartition(7)
    bad = spark.createDataFrame([("a", [[1.0, None, 2.0], [1.0, 2.0, 3.0]], [[9.0, 9.0]]), ("a", [[1.0] * 3] * 2, None), ("b", [[1.0] * 3] * 2, [])], schema)
    fit = forecast.fit_forecaster(whole.unionByName(bad), 1, ("p", "q"), split=(whole.unionByName(bad), whole))
    assert np.allclose(fit.weights, weights) and max(fit.scores.values()) < 1e-12
    assert {r.station: [round(v, 9) for v in r.level] for r in fit.levels.collect()} == {k: [v, v] for k, v in level.items()}
    ridge = forecast.fit_forecaster(whole, 1, ("p", "q"), split=(whole, whole), reg_param=0.1)
    hot = np.array([[k == s for s in level] for k in keys], float)
    z = np.hstack([x.reshape(300, 6), hot])
    assert np.allclose(ridge.weights, np.linalg.solve(z.T @ z + 30 * np.eye(9), z.T @ y)[:6])
    # The same number twice, and one that never changes: the data leave weights open.
    open_ = whole.withColumn("x", F.transform("x", lambda r: F.array(r[0], r[0], F.lit(0.0))))
    assert np.isfinite(forecast.fit_forecaster(open_, 1, ("p", "q"), split=(open_, open_)).weights).all()
    assert fit.predict(bad).where("p_day1 IS NULL").count() == 1
    with pytest.raises(ValueError):
        forecast.fit_forecaster(bad, 1, ("p", "q"), split=(bad, bad))


def square_with_noise():
    x0, y0, s = -104.9903, 39.7392, .1
    ring = [(x0, y0), (x0 + s, y0), (x0 + s, y0 + s), (x0, y0 + s), (x0, y0)]
    return ring + [(x0 + i * .0005, y0 + i * .0005) for i in range(1, 200)]


RING = "polygon_id string, ring array<struct<lon:double,lat:double>>"


def test_simplification(spark):
    circle = [(math.cos(a) + .001 * math.sin(40 * a), math.sin(a)) for a in np.linspace(0, 2 * math.pi, 2000, endpoint=False)]
    flat = [(0., 0.), (1., 0.), (2., 0.), (2., 2.), (0., 2.), (0., 1.), (0., 0.)]
    df = spark.createDataFrame([("circle", circle), ("flat", flat), ("self", square_with_noise())], RING)
    got = {r.polygon_id: [(p.lon, p.lat) for p in r.ring] for r in simplify.simplify_rings(df, .01).collect()}
    assert got["flat"] == [(0., 0.), (2., 0.), (2., 2.), (0., 2.), (0., 0.)]
    assert 8 < len(got["circle"]) < 100 and not simplify.self_intersects(np.array(got["circle"]))
    assert got["self"][0] == got["self"][-1]  # already crosses itself: kept whole
    xs = np.linspace(-1.1, 1.1, 200)
    px, py = [a.ravel() for a in np.meshgrid(xs, xs)]
    a, b = _inside(px, py, circle), _inside(px, py, got["circle"])
    assert (a & b).sum() / (a | b).sum() >= .92


def _inside(px, py, ring):
    out = np.zeros(len(px), bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            out ^= ((y1 > py) != (y2 > py)) & (x1 + (py - y1) * (x2 - x1) / (y2 - y1) > px)
    return out


def test_rdp_keeps_strictly_farther_points_and_whole_rings(spark):
    line = [(0., 0.), (1., 1.), (2., 0.), (3., 1.5), (4., 0.)]
    df = spark.createDataFrame([("l", line), ("two", line[:2]), ("one", line[:1]), ("none", None), ("ring", [(0., 0.), (4., 0.), (4., .1), (0., .1), (0., 0.)])], RING)
    got = {r.polygon_id: None if r.ring is None else [p.lon for p in r.ring] for r in simplify.simplify_rdp(df, 1.0).collect()}
    assert got["l"] == [0., 3., 4.] and got["two"] == [0., 1.] and got["one"] == [0.] and got["none"] is None
    assert len(got["ring"]) >= 4


def plain_rdp(p, eps, seg):
    def away(i, a, b):
        d, o = p[b] - p[a], p[i] - p[a]
        n = float(d @ d)
        if not n:
            return float(np.hypot(*o)) if seg else 0.0
        if seg:
            return float(np.hypot(*(o - min(max(float(o @ d) / n, 0), 1) * d)))
        return abs(float(d[0] * o[1] - d[1] * o[0])) / n ** .5
    kept, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            i = max(range(a + 1, b), key=lambda k: away(k, a, b))
            if away(i, a, b) > eps:
                kept.add(i)
                todo += [(a, i), (i, b)]
    return sorted(kept)


def test_lines_walked_together_are_lines_walked_alone():
    rng = np.random.default_rng(3)
    lines = [np.column_stack([np.arange(n * 1.), rng.normal(size=n).cumsum()]) for n in (2, 3, 17, 200, 55)]
    lines.append(np.zeros((6, 2)))
    ends = np.cumsum([len(p) for p in lines])
    starts = ends - [len(p) for p in lines]
    eps = np.array([1., .5, 1.5, 1.5, .2, 1.])
    for seg in (False, True):
        keep = simplify.keep_lines(np.concatenate(lines), starts, ends - 1, eps, seg)
        for p, a, b, e in zip(lines, starts, ends, eps):
            assert np.flatnonzero(keep[a:b]).tolist() == plain_rdp(p, e, seg)


def test_a_ring_that_touches_itself_is_simplified_once():
    line = np.linspace(0, 4, 200)
    ring = np.concatenate([[[0., 0.], [4., 0.], [4., 4.]], np.column_stack([line, line])[::-1], [[0., 4.], [4., 0.], [0., 0.]]])
    assert simplify.self_intersects(ring)
    kept = simplify.keep_simple_rings([ring], np.array([.01]))[0]
    assert 4 <= len(kept) < 20


def test_sweep_in_pieces_finds_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = rng.integers(4, 30)
        a = np.sort(rng.uniform(0, 6.28, n)) + rng.normal(0, .15, n)
        p = np.column_stack([np.cos(a), np.sin(a)])
        p = np.vstack([p, p[:1]])
        first = simplify.self_intersects(p)
        with monkeypatch.context() as m:
            m.setattr(simplify, "_PAIRS", 1)
            assert simplify.self_intersects(p) == first



def test_clean_rings_is_idempotent_and_counter_clockwise(spark):
    df = spark.createDataFrame([("cw", [(0., 0.), (0., 1.), (0., 1.), (1., 1.), (1., 0.)]), ("ok", [(0., 0.), (1., 0.), (1., 1.), (0., 0.)])], RING)
    once = rings.clean_rings(df)
    got = {r.polygon_id: [tuple(p) for p in r.ring] for r in once.collect()}
    assert got == {"cw": [(0., 0.), (1., 0.), (1., 1.), (0., 1.), (0., 0.)], "ok": [(0., 0.), (1., 0.), (1., 1.), (0., 0.)]}
    assert all(r[0] for r in once.select(rings.is_ccw(F.col("ring"))).collect())
    assert sorted(once.collect()) == sorted(rings.clean_rings(once).collect())


def test_geometry_requests(spark):
    good = ['{"type":"Polygon","coordinates":[[[-100,40],[-90,40],[-90,45],[-100,40]]]}', '{"type":"Point","coordinates":[40,-100]}']
    bad = ['{"coordinates":[40,-100]}', '{"type":"Point"}', '{"type":"Point","coordinates":"abc"}', '{"type":"Polygon","coordinates":[[[1,2],[3]]]}',
           '{"type":"LineString","coordinates":[[0,0],[1,1]]}', '{"type":"Polygon","coordinates":[[[1,2', "40,-100", "", None]
    df = spark.createDataFrame([(g,) for g in good + bad], "g string").select(nested.parse_geometry(F.col("g")).alias("p"))
    assert [r.p is not None for r in df.collect()] == [True] * 2 + [False] * len(bad)
    points = [("40,-105.5", "2022-07-30", True), ("100,-105", "2022-07-30", False), ("40,200", "2022-07-30", False), ("abc", "2022-07-30", False),
              ("40,-105", "07/30/2022", False), (None, "2022-07-30", False), ("40,-105", None, False), ("40,-105", "2022-02-30", False)]
    got = spark.createDataFrame(points, "p string, d string, ok boolean").select(nested.point_request_ok(F.col("p"), F.col("d")), "ok").collect()
    assert all(a == b for a, b in got)


def test_haversine_is_symmetric_and_zero_on_the_spot(spark):
    df = spark.createDataFrame([(40.0, -105.0, 38.52, -106.96), (90.0, 0.0, -90.0, 0.0), (0.0, 179.9, 0.0, -179.9)], "a double, b double, c double, d double")
    k = numeric.haversine_km
    for r in df.select(k(*map(F.col, "abcd")).alias("x"), k(*map(F.col, "cdab")).alias("y"), k(*map(F.col, "abab")).alias("z")).collect():
        assert abs(r.x - r.y) < 1e-9 and r.z == 0.0
    assert abs(df.select(k(*map(F.col, "abcd"))).collect()[1][0] - math.pi * 6371) < 1e-6


def test_snow_request(spark):
    from freshet.sources import snow
    wide = spark.createDataFrame([("south_platte", "01-01", {"2024": 1.5}), ("upper_south_platte", "01-01", {"2024": 2.5})], "basin string, month_day string, years map<string,double>")
    asked = spark.createDataFrame([("South Platte", "basin"), ("Upper South Platte", "SubBasin"), ("South Platte", "unknown"), ("nowhere", "basin")], "basin_name string, basin_type string")
    got = watershed.basin_snow(asked, snow.basin_dim(spark), wide, "2024-01-01", "2024-12-31")
    assert {(r.basin_name, r.swe) for r in got.collect()} == {("South Platte", 1.5), ("Upper South Platte", 2.5)}
    slashed = spark.createDataFrame([("Yampa/White/Little Snake", "basin")], "basin_name string, basin_type string")
    assert filters.resolve_basin(slashed, snow.basin_dim(spark)).count() == 1  # slashes on both sides
    with pytest.raises(ValueError):
        watershed.basin_snow(asked, snow.basin_dim(spark), wide, "2024-01-02", "2024-01-01")


def test_train_job_from_combined_to_saved_model(spark, landing):
    """Flows that grow by a step of their own per gauge: the next days follow from the last, so no error is left."""
    days = [(f"s{k}", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(k % 10 + d % 5), float(k % 10 + d % 7 + 9),
             float(k % 13 + d * (k % 7 + 1)), float(k % 17 + 50 + d * (k % 5 + 2))) for k in range(4) for d in range(30)]
    model = forecast.train_forecaster(spark.createDataFrame(days, COMBINED), history=3, forecast=1, horizon=1, reg_param=1e-9, path=f"{landing}/model")
    assert set(model.scores) == {"min_flow_day1", "max_flow_day1"} and all(v < 1e-6 for v in model.scores.values())
    assert forecast.load_forecaster(spark, f"{landing}/model").scores == model.scores
