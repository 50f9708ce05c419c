"""Polygon and nearest-station joins against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import rings
from freshet.operators import filters, grids, joins, nearest, spatial, walk

POLY = "polygon_id string, ring array<struct<lon:double,lat:double>>"


def star(rng, x, y, r, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + r * rng.uniform(.3, 1) * math.cos(a), y + r * rng.uniform(.3, 1) * math.sin(a)) for a in angles]


def polygons(seed=1):
    rng = random.Random(seed)
    out = [("box", [(-106.0, 38.0), (-105.0, 38.0), (-105.0, 39.0), (-106.0, 39.0)]),
           ("concave", [(-107.0, 37.0), (-104.0, 37.0), (-104.0, 40.0), (-105.5, 37.5), (-107.0, 40.0), (-107.0, 37.0)]),
           ("tiny", [(-105.51, 38.51), (-105.49, 38.51), (-105.49, 38.53), (-105.51, 38.53)])]
    for i in range(12):
        out.append((f"s{i}", star(rng, rng.uniform(-108, -104), rng.uniform(37, 40), 10 ** rng.uniform(-2, .5), rng.choice([3, 8, 40, 900]))))
    return out


def points(seed=2, n=3000):
    rng = random.Random(seed)
    out = [(i, rng.uniform(-109, -103), rng.uniform(36, 41)) for i in range(n)]
    out += [(n + i, -109 + (i % 60) * .1, 36 + (i // 60) * .1) for i in range(3000)]  # a lattice: meets edges and corners
    out += [(n + 3000 + i, -105.5 + rng.uniform(-.02, .02), 38.52 + rng.uniform(-.02, .02)) for i in range(500)]
    return out


def edges_of(ring):
    ring = ring if ring[0] == ring[-1] else ring + [ring[0]]
    return list(zip(ring, ring[1:]))


def brute(px, py, ring):
    """(strictly inside, distance to boundary), vectorised over points."""
    inside, edge, dist = np.zeros(len(px), bool), np.zeros(len(px), bool), np.full(len(px), np.inf)
    for (x1, y1), (x2, y2) in edges_of(ring):
        if y1 != y2:
            inside ^= ((y1 > py) != (y2 > py)) & (x1 + (py - y1) * (x2 - x1) / (y2 - y1) > px)
        edge |= ((x2 - x1) * (py - y1) == (px - x1) * (y2 - y1)) & (px >= min(x1, x2)) & (px <= max(x1, x2)) \
            & (py >= min(y1, y2)) & (py <= max(y1, y2))
        dx, dy = x2 - x1, y2 - y1
        L = dx * dx + dy * dy
        t = np.clip(((px - x1) * dx + (py - y1) * dy) / L, 0, 1) if L else np.zeros(len(px))
        dist = np.minimum(dist, np.hypot(px - x1 - t * dx, py - y1 - t * dy))
    return inside & ~edge, dist


def frames(spark, pts, polys):
    p = spark.createDataFrame(pts, "pid long, lon double, lat double")
    return p, spark.createDataFrame([(k, [{"lon": a, "lat": b} for a, b in r]) for k, r in polys], POLY)


@pytest.mark.parametrize("salts", [1, 4])
def test_points_in_polygons(spark, salts):
    pts, polys = points(), polygons()
    p, q = frames(spark, pts, polys)
    got = {(r.pid, r.polygon_id) for r in spatial.points_in_polygons(p, q, salts=salts).collect()}
    px, py = np.array([a[1] for a in pts]), np.array([a[2] for a in pts])
    want = {(pts[i][0], k) for k, r in polys for i in np.flatnonzero(brute(px, py, r)[0])}
    assert got == want and len(want) > 500


@pytest.mark.parametrize("d", [0.01, 0.3])
def test_within_distance(spark, d):
    pts, polys = points(3), polygons(3)
    p, q = frames(spark, pts, polys)
    rows = spatial.within_distance(p, q, d).select("pid", "polygon_id").collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    px, py = np.array([a[1] for a in pts]), np.array([a[2] for a in pts])
    want, close = set(), set()
    for k, r in polys:
        inside, dist = brute(px, py, r)
        want |= {(pts[i][0], k) for i in np.flatnonzero(inside | (dist <= d))}
        close |= {(pts[i][0], k) for i in np.flatnonzero(abs(dist - d) < 1e-9)}
    assert got - close == want - close


def test_one_ring_test_agrees(spark):
    pts, polys = points(4, 300)[:900], polygons(4)[:5]
    p, q = frames(spark, pts, polys)
    for k, r in polys:
        one = q.where(F.col("polygon_id") == k).select("ring").first()
        ring = F.array(*[F.struct(F.lit(v.lon).alias("lon"), F.lit(v.lat).alias("lat")) for v in one.ring[:40]])
        got = {x.pid for x in p.where(rings.ring_contains(rings.close_ring(ring), F.col("lon"), F.col("lat"))).collect()}
        px, py = np.array([a[1] for a in pts]), np.array([a[2] for a in pts])
        assert got == {pts[i][0] for i in np.flatnonzero(brute(px, py, r[:40])[0])}


def test_first_watershed_wins_and_boundary_is_outside(spark):
    polys = spark.createDataFrame(
        [(8, "b2", "B", 1, [(0., 0.), (2., 0.), (2., 2.), (0., 2.)]), (8, "a1", "A", 2, [(1., 1.), (3., 1.), (3., 3.), (1., 3.)]),
         (8, "c", None, 0, [(0., 0.), (9., 0.), (9., 9.), (0., 9.)]), (6, "z", "Z", 0, [(0., 0.), (9., 0.), (9., 9.), (0., 9.)])],
        "huc_level int, huc_id string, name string, pos int, ring array<struct<lon:double,lat:double>>")
    pts = spark.createDataFrame([(1, 1.5, 1.5), (2, 2.5, 2.5), (3, 0.0, 1.0), (4, 8.0, 8.0)], "point_id int, lon double, lat double")
    by_pos = {r.point_id: r.huc_id for r in spatial.assign_watershed(pts, polys, level=8, order="pos").collect()}
    assert by_pos == {1: "b2", 2: "a1"}
    by_id = {r.point_id: r.huc_id for r in spatial.huc_for_points(pts, polys, 8).collect()}
    assert by_id == {1: "a1", 2: "a1"}
    assert {r.point_id for r in spatial.huc_for_points(pts, polys, 6).collect()} == {1, 2, 3, 4} - {3}
    with pytest.raises(ValueError):
        spatial.huc_for_points(pts, polys, 10)


def test_first_watershed_is_found_without_sorting_pairs(spark):
    square = [(0., 0.), (4., 0.), (4., 4.), (0., 4.)]
    rows = [(8, i, n, r) for i, n, r in (("b", "B2", square), ("b", "B1", square), ("a", "A", [(1., 1.), (3., 1.), (3., 3.), (1., 3.)]),
                                         ("b", "B0", None), (None, "N", square), ("0", None, square))]
    polys = spark.createDataFrame(rows, "huc_level int, huc_id string, name string, ring array<struct<lon:double,lat:double>>")
    pts = spark.createDataFrame([("p", 2., 2.), ("q", .5, .5), (None, .5, 2.), (None, 2., 2.5), ("r", None, 1.), ("s", 9., 9.)], "point_id string, lon double, lat double")
    out = spatial.assign_watershed(pts, polys)
    assert {tuple(r) for r in out.collect()} == {("p", 2., 2., "a", "A"), ("q", .5, .5, "b", "B1"), (None, 2., 2.5, "a", "A")}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_huc4_code(spark):
    df = spark.createDataFrame([(4, "14", None, "gunnison river"), (8, "14", "14020001", "x"), (8, "14", None, "x")],
                               "l int, h string, c string, n string")
    got = [r[0] for r in df.select(spatial.huc_code(F.col("l"), F.col("h"), F.col("c"), F.col("n"))).collect()]
    assert got == ["14GU", "14020001", "Unknown"]


def test_all_touched_takes_every_cell_an_edge_crosses(spark):
    cells = [(i, -106.45 + .1 * (i % 20), 37.65 + .1 * (i // 20)) for i in range(400)]
    polys = polygons(7)
    p, q = frames(spark, cells, polys)
    plain = {(r.pid, r.polygon_id) for r in grids.clip_cells(p, q).collect()}
    touched = {(r.pid, r.polygon_id) for r in grids.clip_cells(p, q, all_touched=True, half=(.05, .05)).collect()}
    want = set()
    px, py = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
    for k, r in polys:
        inside, dist = brute(px, py, r)
        for i, (pid, x, y) in enumerate(cells):
            box = (x - .05, y - .05, x + .05, y + .05)
            if inside[i] or dist[i] < .08 and any(_meets(e, box) for e in edges_of(r)):
                want.add((pid, k))
    assert plain <= touched and touched == want


def _meets(edge, box):
    """Liang-Barsky clipping: does the segment keep any part inside the closed box?"""
    (x1, y1), (x2, y2) = edge
    t0, t1 = 0.0, 1.0
    for p, q in ((x1 - x2, x1 - box[0]), (x2 - x1, box[2] - x1), (y1 - y2, y1 - box[1]), (y2 - y1, box[3] - y1)):
        if p == 0:
            if q < 0:
                return False
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    return t0 <= t1


def test_expanding_mean_uses_the_first_radius_that_reaches_cells(spark):
    square = [(0., 0.), (1., 0.), (1., 1.), (0., 1.)]
    cells = spark.createDataFrame(
        [(.5, .5, 1.), (.2, .2, 3.), (1.04, .5, 50.), (5.06, 5.5, 7.), (4.93, 5.5, 9.), (4.91, 5.5, 99.), (.6, .6, None), (20.5, 20.5, None)],
        "lon double, lat double, value double")
    polys = spark.createDataFrame(
        [(k, [(x + d, y + d) for x, y in square]) for k, d in (("full", 0.), ("gone", 20.), ("none", 50.))]
        + [("near", [(5., 5.), (5.05, 5.), (5.05, 6.), (5., 6.)])], POLY)
    got = {r.polygon_id: r for r in grids.zonal_mean_expanding(cells, polys).collect()}
    assert (got["full"].mean_value, got["full"].n_cells, got["full"].radius) == (2.0, 2, 0.0)
    assert (got["near"].mean_value, got["near"].n_cells, got["near"].radius) == (7.0, 1, 0.025)
    assert got["gone"].mean_value is None and got["none"].mean_value is None
    plain = {r.polygon_id: r.mean_value for r in grids.zonal_mean(cells, polys).collect()}
    assert plain == {"full": 2.0, "near": None, "gone": None, "none": None}


def test_availability_counts_squares(spark):
    rng = random.Random(21)
    cells = [(rng.choice(["g", "h", None]), rng.uniform(0, 8), rng.uniform(0, 6), rng.choice([None, 1.0])) for _ in range(2500)]
    cells += [("g", 2 + rng.gauss(0, .01), 3 + rng.gauss(0, .01), 1.0) for _ in range(800)]
    cells += [("g", float(i % 9), float(i // 9), 1.0) for i in range(60)] + [("g", None, 1.0, 1.0), ("h", math.nan, 1.0, 1.0)]
    boxes = [(i, x, y, x + rng.uniform(0, 5), y + rng.uniform(0, 4)) for i, x, y in ((i, rng.uniform(-1, 6), rng.uniform(-1, 5)) for i in range(20))]
    boxes += [boxes[0], (50, 1.0, 1.0, 4.0, 4.0), (51, 50.0, 50.0, 51.0, 51.0), (52, 3.0, 3.0, 2.5, 2.5), (53, None, 1.0, 2.0, 2.0), (None, -9.0, -9.0, 20.0, 20.0)]
    c = spark.createDataFrame(cells, "grid_id string, lon double, lat double, value double")
    b = spark.createDataFrame(boxes, "polygon_id int, min_lon double, min_lat double, max_lon double, max_lat double")
    got = {(r.polygon_id, r.grid_id): (r.total, r.valid, r.valid_around) for r in grids.grid_availability(c, b, margin=.5).collect()}
    want = {}
    for k, x0, y0, x1, y1 in boxes:
        for g, x, y, v in cells:
            if None in (x0, x, y) or not (x0 - .5 <= x <= x1 + .5 and y0 - .5 <= y <= y1 + .5):
                continue
            hit, n = x0 <= x <= x1 and y0 <= y <= y1, want.setdefault((k, g), [0, 0, 0])
            for i, add in enumerate((hit, hit and v is not None, v is not None)):
                n[i] += add
    met = {k: v for k, v in got.items() if k in want and k[0] is not None}
    assert met == {k: tuple(v) for k, v in want.items() if k[0] is not None} and got[(51, None)] == (0, 0, 0)
    # A box of everything takes some rows for its inside, not one for each of its cells.
    every = spark.sql("SELECT 1 AS polygon_id, -9D AS x0, -9D AS y0, 20D AS x1, 20D AS y1")
    counted = grids.box_counts(c, every).agg(F.sum("_n"), F.count("*")).first()
    assert counted[0] == len(cells) - 2 and counted[1] < 1000


def test_bounds_overlap_is_exact(spark):
    df = spark.createDataFrame([("p", [(0., 0.), (4., 0.), (0., 4.)])], POLY)
    cases = {(1, 1, 2, 2): True, (3.5, 3.5, 5, 5): False, (-1, -1, 9, 9): True, (.1, .1, .2, .2): True, (2.1, 2.1, 3, 3): False, (4, 0, 5, 1): True}
    for box, want in cases.items():
        assert df.select(rings.intersects_bounds(F.col("ring"), box)).first()[0] is want, box


def test_granules_for_requests_is_the_plain_overlap(spark):
    rng = random.Random(9)

    def boxes(n, tag):
        out = []
        for i in range(n):
            x, y, w, h = rng.uniform(-180, 150), rng.uniform(-80, 60), 10 ** rng.uniform(-2, 1.5), 10 ** rng.uniform(-2, 1.2)
            d = rng.randint(1, 20)
            out.append((f"{tag}{i}", x, y, x + w, y + h, d, d + rng.randint(0, 5), float(rng.randint(1, 5))))
        return out + [(f"{tag}world", -180., -90., 180., 90., 5, 6, 9.)]

    a, b = boxes(60, "r"), boxes(120, "g")

    def frame(rows, name):
        df = spark.createDataFrame(rows, f"{name} string, min_lon double, min_lat double, max_lon double, max_lat double, s int, e int, size_mb double")
        return df.withColumns({"start": F.make_date(F.lit(2020), F.lit(1), "s"), "end": F.make_date(F.lit(2020), F.lit(1), "e")}).drop("s", "e")

    rows = spatial.granules_for_requests(frame(a, "request_id").drop("size_mb"), frame(b, "granule_id")).collect()
    want = {(r[0], g[0]) for r in a for g in b if r[1] <= g[3] and g[1] <= r[3] and r[2] <= g[4] and g[2] <= r[4] and r[5] <= g[6] and g[5] <= r[6]}
    assert {(r.request_id, r.granule_id) for r in rows} == want and len(rows) == len(want)


def test_ranges_without_an_end_meet_only_what_they_overlap(spark):
    """Rows that are both finer than a bucket or a span are not joined in it, only to be dropped."""
    day = "date_add(DATE'2020-01-01', CAST(id % 300 AS INT))"
    short = spark.range(600).selectExpr("id AS request_id", "id % 3 * 4.0D AS min_lon", "0D AS min_lat", "id % 3 * 4.0D + 0.1D AS max_lon", "0.1D AS max_lat", f"{day} AS start", f"{day} AS `end`")
    ever = spark.sql("SELECT 1000L AS request_id, 0D AS min_lon, 0D AS min_lat, 60D AS max_lon, 60D AS max_lat, DATE'2020-01-01' AS start, DATE'9999-12-31' AS `end`")
    granules = short.unionByName(ever).withColumnRenamed("request_id", "granule_id")
    found = spatial.granules_for_requests(short.unionByName(ever), granules, salts=1)
    # 600 short ones meet the 2 of the same place and day, and the long one meets all.
    assert found.count() == 600 * 2 + 600 * 2 + 1
    joined = found._jdf.queryExecution().optimizedPlan()
    while joined.nodeName() != "Join":
        joined = joined.children().apply(0)
    sides = [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, joined.children().apply(i)) for i in (0, 1)]
    left, right = (type(found)(side, spark) for side in sides)
    keys = ["_lvl", "_wide", "_bx", "_by", "_span", "_long", "_day"]
    counts = left.groupBy(*keys).count().join(right.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    assert counts.agg(F.sum(F.col("count") * F.col("m"))).first()[0] < 20_000  # 600 * 600 and more before


def _first_join(df):
    plan = df._jdf.queryExecution().sparkPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().apply(0)
    return plan.nodeName()


def test_laid_out_requests_are_not_sent_to_all_tasks(spark):
    """Few requests make many rows; their tables' size doesn't tell."""
    day = "date_add(DATE'2020-01-01', CAST(id % 30 AS INT))"
    rows = spark.range(200).selectExpr("id AS request_id", "id % 7 * 1.0D AS min_lon", "0D AS min_lat", "id % 7 + 0.3D AS max_lon", "0.3D AS max_lat", f"{day} AS start", f"date_add({day}, 2) AS `end`")
    found = spatial.granules_for_requests(rows, rows.withColumnRenamed("request_id", "granule_id"))
    assert _first_join(found) == "SortMergeJoin"
    want = sum(i % 7 == j % 7 and abs(i % 30 - j % 30) <= 2 for i in range(200) for j in range(200))
    assert found.count() == want == found.distinct().count()


def test_granules_meet_requests_at_bounds_and_with_gaps(spark):
    """Boxes that only touch, points, reversed boxes, missing sides, ids that repeat, days against times of day."""
    from datetime import date, datetime
    a = [(1, 0., 0., 1., 1., date(2020, 1, 1), date(2020, 1, 2)), (1, 0., 0., 1., 1., date(2020, 1, 1), date(2020, 1, 2)), (2, 5., 0., 3., 1., date(2020, 1, 1), date(2020, 1, 9)),
         (None, -170., -80., 170., 80., date(2020, 1, 2), date(2020, 1, 2)), (4, None, 0., 1., 1., date(2020, 1, 1), date(2020, 1, 9)), (5, 0., 0., 1., 1., date(2020, 1, 3), date(2020, 1, 2))]
    b = [(10, 1., 1., 1., 1., datetime(2020, 1, 2, 23), datetime(2020, 1, 3, 1)), (11, -1., -1., 0., 0., datetime(2019, 12, 1), datetime(2020, 1, 1)), (12, 2., 0., 6., 1., datetime(2020, 1, 9, 5), datetime(9999, 12, 31)),
         (13, 1.0000001, 0., 2., 1., datetime(2020, 1, 1), datetime(2020, 1, 2)), (14, 0., 0., 1., None, datetime(2020, 1, 1), datetime(2020, 1, 2)), (15, .5, .5, .6, .6, None, datetime(2020, 1, 2))]
    box = "min_lon double, min_lat double, max_lon double, max_lat double"
    requests = spark.createDataFrame(a, f"request_id int, {box}, start date, end date")
    granules = spark.createDataFrame(b, f"granule_id int, {box}, start timestamp, end timestamp")
    got = sorted(((r.request_id or 0, r.granule_id) for r in spatial.granules_for_requests(requests, granules).collect()))
    assert got == [(0, 10), (0, 13), (1, 10), (1, 10), (1, 11), (1, 11), (2, 12)]


def test_the_least_sizes_are_written_before_granules_are_told_by_them(spark):
    df = spark.range(100).selectExpr("id % 5 AS request_id", "id AS granule_id", "id % 10 * 1.0D AS size_mb")
    out = filters.smallest_granule(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "parquet" in plan and "strategy=broadcast" in plan
    assert {(r.request_id, r.granule_id) for r in out.collect()} == {(i, i) for i in range(5)}


def test_squares_of_boxes_are_not_sent_to_all_tasks(spark):
    cells = spark.range(2000).selectExpr("'g' AS grid_id", "id % 50 * 1.0D AS lon", "id % 40 * 1.0D AS lat", "1.0D AS value")
    boxes = spark.range(20).selectExpr("id AS k", "id * 1.0D AS x0", "0.0D AS y0", "id + 20.0D AS x1", "20.0D AS y1")
    counted = grids.box_counts(cells, boxes)
    names = [n.nodeName() for n in _nodes(counted._jdf.queryExecution().sparkPlan()) if "Join" in n.nodeName()]
    assert names and set(names) == {"SortMergeJoin"}
    got = {r.k: r.n for r in counted.groupBy("k").agg(F.sum("_n").alias("n")).collect()}
    assert got == {k: sum(k <= i % 50 <= k + 20 and i % 40 <= 20 for i in range(2000)) for k in range(20)}


def test_overlap_is_counted_without_pairs(spark):
    """Versions in parts, of few and of many edges, cells that come again, at two places, without an id or a place."""
    rng = random.Random(31)
    circle = lambda x, y, r, n: [(x + r * math.cos(6.283185 * i / n), y + r * math.sin(6.283185 * i / n)) for i in range(n)]
    first = [("a", circle(0, 0, 1, 9)), ("a", circle(3, 0, 1, 300)), ("a", circle(3, 0, 1, 300)), ("b", circle(1, 1, 2, 500)), ("c", circle(50, 50, 1, 8)), (None, circle(0, 0, 1, 5)), ("d", circle(0, 1, 1, 6))]
    second = [("a", circle(.5, 0, 1, 400)), ("b", circle(1, 1, 2, 500)), ("e", circle(1, 0, 1, 7)), (None, circle(0, 0, 1, 5)), ("d", circle(0, 1, .4, 80))]
    cells = [(i, rng.uniform(-2, 5), rng.uniform(-2, 4)) for i in range(1500)]
    cells += cells[:200] + [(i, rng.uniform(-2, 5), rng.uniform(-2, 4)) for i in range(100, 160)] + [(None, 0., 0.), (None, 3., 0.), (7, None, 1.), (9, math.nan, 0.)]
    where = spark.createDataFrame(cells, "cell_id int, lon double, lat double")
    one, two = (spark.createDataFrame(v, POLY) for v in (first, second))

    def within(version):
        found = spatial.match_polygons(where, version).collect()
        return {(r.polygon_id, r.cell_id) for r in found if r.polygon_id is not None}

    a, b = within(one), within(two)
    want = {k: len([p for p in a & b if p[0] == k]) / max(1, len([p for p in a | b if p[0] == k])) for k in "abde"} | {"c": None, None: None}
    assert want["a"] > 0 and want["b"] == 1
    assert {r.polygon_id: r.iou for r in grids.grid_iou(where, one, two).collect()} == want
    apart = where.where("cell_id >= 200").dropDuplicates(["cell_id"])
    plan = grids.grid_iou(apart, one, two)._jdf.queryExecution().optimizedPlan()
    walked = [n for n in _nodes(plan) if n.nodeName() == "MapInArrow"]
    assert len(walked) == 1 and "either" in walked[0].toString().split("\n")[0]


def test_pairs_that_nobody_measures_are_bare(spark):
    square = spark.createDataFrame([("p", [(0., 0.), (4., 0.), (4., 4.), (0., 4.)])], POLY)
    points = spark.createDataFrame([(1, 1., 1., "in"), (2, 4.5, 1., "near"), (3, 9., 9., None)], "id int, lon double, lat double, value string")
    near = spatial.within_distance(points, square, 1.0, keep=["id"])
    walked = [n for n in _nodes(near._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "MapInArrow"][0]
    assert walked.output().size() == 2
    assert near.columns == ["id", "polygon_id"] and sorted(near.collect()) == [(1, "p"), (2, "p")]
    cells = grids.cells_near_polygon(points, square, 1.0, keep=["id", "value"])
    assert sorted(cells.collect()) == [(1, "in", "p"), (2, "near", "p")]
    assert spatial.points_in_polygons(points, square).columns == [*points.columns, "polygon_id"]
    assert spatial.match_polygons(points, square, margin=1.0).columns[-2:] == ["inside", "away_sq"]


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_smallest_granule_sorts_only_the_least_sizes(spark):
    rows = [(1, 5, 2.0), (1, 4, 2.0), (1, 9, 1.5), (1, 8, 1.5), (2, 3, None), (2, 1, 0.5), (2, 2, None), (None, 7, 4.0), (None, 6, float("nan")), (3, 5, float("nan"))]
    df = spark.createDataFrame(rows, "request_id int, granule_id int, size_mb double")
    out = filters.smallest_granule(df)
    assert {(r.request_id, r.granule_id) for r in out.collect()} == {(1, 8), (2, 2), (None, 7), (3, 5)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("k", [1, 5, 50])
def test_nearest_stations_is_brute_force(spark, k):
    rng = random.Random(11)
    st = [(f"S{i:04d}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)]
    st += [(f"H{i:04d}", 38 + rng.gauss(0, .02), -105 + rng.gauss(0, .02)) for i in range(300)]  # a dense cluster
    st += [(f"D{i:04d}", 40.0, -105.0) for i in range(150)]  # many on one spot
    sites = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    sites += [(100, 38.0, -105.0), (101, 40.0, -105.0), (102, 39.0, -105.0), (103, 90.0, 0.0), (104, -89.9, 179.9), (105, 0.0, -180.0), (106, 0.0, 180.0), (107, 40.0, -105.0)]
    got = nearest.nearest_stations(spark.createDataFrame(sites, "site_id long, lat double, lon double"),
                                   spark.createDataFrame(st, "wx_id string, lat double, lon double"), k)
    by_site = {}
    for r in got.collect():
        by_site.setdefault(r.site_id, []).append((r["rank"], r.wx_id))
    for sid, la, lo in sites:
        want = sorted((round(haversine(la, lo, b, c), 6), w) for w, b, c in st)[:k]
        assert [w for _, w in sorted(by_site[sid])] == [w for _, w in want], sid


def test_nearest_with_fewer_stations_than_k(spark):
    sites = spark.createDataFrame([(1, 10.0, 10.0)], "site_id long, lat double, lon double")
    st = spark.createDataFrame([("A", -60.0, 170.0), ("B", 11.0, 10.0), ("C", None, 1.0)], "wx_id string, lat double, lon double")
    assert [r.wx_id for r in nearest.nearest_stations(sites, st).orderBy("rank").collect()] == ["B", "A"]


def test_first_fit_station(spark):
    st = [("USW00000001", 40.0, -105.0), ("USW00000002", 40.1, -105.0), ("USW00000003", 40.2, -105.0),
          ("USW00000004", 40.3, -105.0), ("USBAD", 40.0, -105.0), ("CA000000001", 40.0, -105.0)]
    meta = [("GHCND:USW00000001", .87, "2000-01-01", "2030-01-01"), ("GHCND:USW00000002", .9, "2000-01-01", "2019-12-28"),
            ("USW00000003", .9, "2000-01-01", "2019-12-29"), ("GHCND:USW00000004", .99, "2000-01-01", "2030-01-01"),
            ("GHCND:CA000000001", .99, "2000-01-01", "2030-01-01")]
    fields = [(w.split(":")[-1], f) for w, *_ in meta for f in ("TMIN", "TMAX", "PRCP")]
    sites = spark.createDataFrame([("x", 40.0, -105.0), ("y", 40.0, -105.0), ("z", None, None)], "site_id string, lat double, lon double")
    m = spark.createDataFrame(meta, "wx_id string, datacoverage double, a string, b string").select(
        "wx_id", "datacoverage", F.col("a").cast("date").alias("mindate"), F.col("b").cast("date").alias("maxdate"))
    args = (sites, spark.createDataFrame(st, "wx_id string, lat double, lon double"), m)

    def run(fields, **kw):
        f = spark.createDataFrame(fields, "wx_id string, datatype string")
        return {r.site_id: (r.noaa_station, r["rank"]) for r in nearest.nearest_fit_station(*args, f, "2020-01-01", "2020-06-01", **kw).collect()}

    # coverage of exactly 0.87 is not enough; three days before the start is
    assert run(fields) == {"x": ("USW00000003", 3), "y": ("USW00000003", 3)}
    no_max = [f for f in fields if f != ("USW00000003", "TMAX")]
    assert run(no_max)["x"] == ("USW00000004", 4)
    assert run(no_max, k=3) == {}


@pytest.mark.parametrize("margin", [0.0, 0.05])
def test_dense_outlines_are_quartered(spark, margin):
    rng = random.Random(5)
    angles = sorted([rng.uniform(0, .03) for _ in range(700)] + [rng.uniform(0, 2 * math.pi) for _ in range(300)])
    blob = [(.3 + (1 + .2 * math.sin(7 * a)) * math.cos(a), .4 + (1 + .2 * math.sin(7 * a)) * math.sin(a)) for a in angles]
    hole = [(.3 + .1 * math.cos(a / 50), .4 + .1 * math.sin(a / 50)) for a in range(314)]
    rings = spark.createDataFrame([("a", blob), ("a", hole), ("b", [(0., 0.), (1., 0.), (0., 1.)])], "polygon_id string, ring array<struct<lon:double,lat:double>>")
    points = [(i, rng.uniform(-1, 1.6), rng.uniform(-1, 1.7)) for i in range(400)] + [(1000 + i, 1.3 + rng.gauss(0, .01), .4 + rng.gauss(0, .01)) for i in range(300)]
    df = spark.createDataFrame(points, "pid int, lon double, lat double")
    buckets = None if margin else spatial.ring_buckets(spatial.gathered_polygons(rings, "polygon_id", "ring", margin).where("_dense"), "polygon_id", margin)
    assert margin or max(sum(len(x["_edges"]) for x in r["_rings"]) for r in buckets.collect()) <= spatial.MAX_EDGES
    match = spatial.within_distance(df, rings, margin) if margin else spatial.points_in_polygons(df, rings)
    got = {(r.pid, r.polygon_id) for r in match.select("pid", "polygon_id").collect()}

    def away(x, y, ring):
        best = math.inf
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            dx, dy = x2 - x1, y2 - y1
            t = max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / ((dx * dx + dy * dy) or 1)))
            best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
        return best

    def inside(x, y, ring):
        return sum((y1 > y) != (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    shapes = {"a": [blob, hole], "b": [[(0., 0.), (1., 0.), (0., 1.)]]}
    want = {(i, k) for i, x, y in points for k, parts in shapes.items() if any(inside(x, y, r) or margin and away(x, y, r) <= margin for r in parts)}
    assert got == want


def test_only_hot_keys_are_split(spark, monkeypatch):
    from freshet.operators import joins
    flat = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    hot = flat.unionByName(spark.range(900).select(F.lit(7).cast("long").alias("k"), (F.col("id") + 5000).alias("id"))).unionByName(spark.range(3).select(F.lit(None).cast("long").alias("k"), "id"))
    names = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("name")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 5L AS name"))
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    assert joins.hot_keys(flat, ["k"]) == {} and list(joins.hot_keys(hot, ["k"]).values()) == [10]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan(joins.lookup(flat, names, ["k"])) and "_salt" in plan(joins.lookup(hot, names, ["k"]))
    for how in ("left", "inner"):
        got = sorted((r.k is not None, r.k or 0, r.id, r.name) for r in joins.lookup(hot, names, ["k"], how).collect())
        assert len(got) == 1903 and all(n == (2 * k if there else 5) for there, k, _, n in got)
    assert joins.lookup(hot, names.where("k <> 7"), ["k"], "left_anti").count() == 913
    assert joins.equi_join(hot, names, ["k"]).count() == 1900 == joins.equi_join(hot, names, ["k"], 3).count()


def crowd(n_points=900, n_squares=60):
    """Points of one bucket or a few, and squares that overlap there, of two parts each."""
    rng = random.Random(7)
    pts = [(i, rng.uniform(-105.2, -105.0), rng.uniform(38.0, 38.2)) for i in range(n_points)]
    parts = []
    for k in range(n_squares):
        for _ in range(2):
            x, y, r = rng.uniform(-105.2, -105.0), rng.uniform(38.0, 38.2), rng.uniform(.01, .06)
            parts.append((k, [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]))
    held = {(p, k) for p, px, py in pts for k, s in parts if s[0][0] < px < s[1][0] and s[0][1] < py < s[2][1]}
    return pts, parts, held


def crowd_frames(spark):
    pts, parts, held = crowd()
    return (spark.createDataFrame(pts, "pid long, lon double, lat double").withColumns({
                "at": F.expr("timestamp_seconds(pid)"), "note": F.when(F.col("pid") % 2 == 0, F.lit("even"))}),
            spark.createDataFrame(parts, "polygon_id long, ring array<struct<lon:double,lat:double>>"), held)


def test_buckets_are_tested_as_arrays_and_go_on_over_batches(spark):
    p, q, held = crowd_frames(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = spatial.match_polygons(p, q)
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.pid, r.polygon_id) for r in rows) == sorted(held)
    assert all(int(r["at"].timestamp()) == r.pid and r.note == ("even" if r.pid % 2 == 0 else None) for r in rows)


def test_hot_buckets_are_split_on_both_sides(spark, monkeypatch):
    p, q, held = crowd_frames(spark)
    monkeypatch.setattr(joins, "_MET_LEFT", 20)
    monkeypatch.setattr(joins, "_MET_RIGHT", 10)
    out = spatial.match_polygons(p, q)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_dealt" in plan and "_salt" in plan
    assert sorted((r.pid, r.polygon_id) for r in out.collect()) == sorted(held)


def test_first_polygon_is_found_without_all_pairs(spark):
    p, q, held = crowd_frames(spark)
    rows = spatial.match_polygons(p, q, first=True).collect()
    first = {i: min(k for j, k in held if j == i) for i in {i for i, _ in held}}
    found = {i: min(r.polygon_id for r in rows if r.pid == i) for i in {r.pid for r in rows}}
    assert found == first and len(rows) < len(held) / 2


def test_points_without_a_place_match_nothing(spark):
    p = spark.createDataFrame([(1, None, 38.5), (2, float("nan"), 38.5), (3, -105.5, float("nan")), (4, -105.5, 38.5)], "pid long, lon double, lat double")
    q = spark.createDataFrame([("box", [(-106.0, 38.0), (-105.0, 38.0), (-105.0, 39.0), (-106.0, 39.0)]), ("none", None)], POLY)
    assert [r.pid for r in spatial.within_distance(p, q, .1).collect()] == [4]


def test_few_tasks_are_dealt_out_before_dear_work(spark):
    df = spark.range(0, 500, 1, 1)
    out = joins.dealt_out(df)
    assert out.rdd.getNumPartitions() >= 8 and sorted(r.id for r in out.collect()) == list(range(500))
    wide = spark.range(0, 500, 1, 64)
    assert joins.dealt_out(wide) is wide


def test_zonal_sums_leave_the_walk_without_pairs(spark):
    p, q, held = crowd_frames(spark)
    cells = p.select("lon", "lat", F.col("pid").cast("double").alias("value")).withColumn("value", F.explode(F.array("value", F.col("value") + 1, F.col("value") + 2)))
    wanted = {}
    for i, k in held:
        total, n = wanted.get(k, (0, 0))
        wanted[k] = total + 3 * i + 3, n + 3
    rows = spatial.match_totals(cells, q, "value").collect()
    assert len(rows) < len(held)
    assert {k: (sum(r.total for r in rows if r.polygon_id == k), sum(r.n for r in rows if r.polygon_id == k)) for k in {r.polygon_id for r in rows}} == wanted
    means = {r.polygon_id: (r.mean_value, r.n_cells) for r in grids.zonal_mean(cells, q).collect()}
    assert means == {r.polygon_id: (None, None) for r in q.collect()} | {k: (t / n, n) for k, (t, n) in wanted.items()}


def test_pairs_carry_only_the_columns_to_keep(spark):
    p, q, held = crowd_frames(spark)
    out = grids.clip_cells(p, q, keep=("pid",))
    assert out.columns == ["pid", "polygon_id"] and sorted(map(tuple, out.collect())) == sorted(held)


def test_buckets_of_one_hash_are_told_apart(spark):
    import pyarrow as pa
    square = lambda x: [x, .0, x + 1, 1.0, 2.0, 4.0, .0, x, .0, x + 1, .0, x + 1, .0, x + 1, 1.0, x + 1, 1.0, x, 1.0, x, 1.0, x, .0]
    piece = pa.struct([("id", pa.int64()), ("_shape", pa.list_(pa.float64()))])
    columns = {"_lvl": pa.array([0] * 6, pa.int32()), "_bx": pa.array([0, 5, 0, 5, 0, 5], pa.int64()), "_by": pa.array([0] * 6, pa.int64()),
               "_at": pa.array([8, 8, 9, 9, 9, 9], pa.int64()), "_x": pa.array([None, None, .5, 5.5, .25, 5.25]), "_y": pa.array([None, None, .5, .5, .5, .5]),
               "_pt": pa.array([None, None, *({"pid": i} for i in range(4))], pa.struct([("pid", pa.int64())])),
               "_piece": pa.array([{"id": 7, "_shape": square(.0)}, {"id": 8, "_shape": square(5.0)}, None, None, None, None], piece)}
    whole = pa.RecordBatch.from_pydict(columns)
    for batches in ([whole], [whole.slice(i, 1) for i in range(6)]):
        found = walk.pairs(iter(batches), ["_lvl", "_bx", "_by"], ["id"], (.4, .7), 0.0, 0.0, None, False)
        assert sorted((r["c0"], r["c1"]) for b in found for r in b.to_pylist()) == [(0, 7), (1, 8), (2, 7), (3, 8)]


def test_pieces_of_small_polygons_are_not_joined(spark):
    p, q, held = crowd_frames(spark)
    out = spatial.match_polygons(p, q)
    assert " Inner" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.pid, r.polygon_id) for r in out.collect()) == sorted(held)
