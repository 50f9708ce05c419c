"""Polygons, grids and granules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CELLS_SQL, OUTLINE, PAIRS_SQL, RINGS_SQL, day_sql, lattice, query
from freshet.functions import nested, rings
from freshet.operators import filters, grids, simplify, spatial
from freshet.operators.joins import dealt_out
from freshet.sources.watershed import ring_vertices

# --- points and cells against polygons ------------------------------------------


@query("points_in_polygons", f"{PAIRS_SQL} SELECT id, k AS polygon_id FROM pair WHERE inside AND d2 > 0")
def _(t):
    return spatial.points_in_polygons(t.cells().select("id", "lat", "lon"), t.rings()).select("id", "polygon_id")


@query("within_distance", f"{PAIRS_SQL} SELECT id, k AS polygon_id FROM pair WHERE inside OR d2 <= pow(0.0213e0, 2)")
def _(t):
    return spatial.within_distance(t.cells().select("id", "lat", "lon"), t.rings(), 0.0213, keep=["id"]).select("id", "polygon_id")


# A square for every supplier, of 100 vertices or, every 25th, of 50,000, half of these in a hundredth of a side.
@query("points_in_dense_rings", f"""WITH {CELLS_SQL}, q AS (SELECT s_suppkey AS k, -109 + (s_suppkey * 7 % 700) / 1e2 + 0.00371e0 AS x, 37 + (s_suppkey * 3 % 400) / 1e2 + 0.00293e0 AS y, 0.1e0 + (s_suppkey % 5) / 10e0 AS h FROM supplier)
SELECT id, k AS polygon_id FROM cell, q WHERE abs(lon - x) < h AND abs(lat - y) < h""")
def _(t):
    k = F.col("s_suppkey")
    x = F.lit(-109) + (k * 7 % 700) / F.lit(100.0) + F.lit(0.00371)
    y = F.lit(37) + (k * 3 % 400) / F.lit(100.0) + F.lit(0.00293)
    n, h = F.when(k % 25 == 0, 50_000).otherwise(100), F.lit(0.1) + (k % 5) / F.lit(10.0)

    def vertex(i):
        share = i / n
        at = 4 * F.when(share < 0.5, share * 0.005).otherwise(0.0025 + (share - 0.5) * 1.995)
        side, f = F.floor(at), at - F.floor(at)
        lon = F.when(side == 0, -1 + 2 * f).when(side == 1, 1.0).when(side == 2, 1 - 2 * f).otherwise(-1.0)
        lat = F.when(side == 0, -1.0).when(side == 1, -1 + 2 * f).when(side == 2, 1.0).otherwise(1 - 2 * f)
        return F.struct((x + h * lon).alias("lon"), (y + h * lat).alias("lat"))

    corners = F.array(*[F.struct((x + h * a).alias("lon"), (y + h * b).alias("lat")) for a, b in ((1, -1), (1, 1), (-1, 1))])
    dense = F.transform(F.sequence(F.lit(0), n - 1), vertex)
    # The corners are vertices too, wherever the walk around the square meets them.
    place = lambda p: F.when(p["lat"] == y - h, F.struct(F.lit(0).alias("s"), p["lon"].alias("d"))).when(
        p["lon"] == x + h, F.struct(F.lit(1).alias("s"), p["lat"].alias("d"))).when(
        p["lat"] == y + h, F.struct(F.lit(2).alias("s"), (-p["lon"]).alias("d"))).otherwise(F.struct(F.lit(3).alias("s"), (-p["lat"]).alias("d")))
    ring = F.transform(F.array_sort(F.transform(F.concat(dense, corners), lambda p: F.struct(place(p).alias("o"), p.alias("p")))), lambda v: v["p"])
    squares = dealt_out(t.supplier.select("s_suppkey")).select(k.alias("polygon_id"), ring.alias("ring"))
    return spatial.points_in_polygons(t.cells().select("id", "lat", "lon"), squares, keep=["id"]).select("id", "polygon_id")


_HUC = """huc AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS huc_id, s_name AS name,
  CASE WHEN s_nationkey < 5 THEN 4 WHEN s_nationkey < 10 THEN 6 ELSE 8 END AS huc_level FROM supplier)"""


def _assigned(where: str) -> str:
    return f"""{PAIRS_SQL}, {_HUC} SELECT id AS point_id, lon, lat, arg_min(huc_id, huc_id) AS huc_id, arg_min(name, huc_id) AS name
FROM pair JOIN huc USING (k) WHERE inside AND d2 > 0 {where} GROUP BY 1, 2, 3"""


def _points(t):
    return t.cells().select(F.col("id").alias("point_id"), "lon", "lat")


@query("assign_watershed", _assigned(""))
def _(t):
    return spatial.assign_watershed(_points(t), t.hucs())


def _twice(polygons, shift):
    """Every ring twice, and a third part of the same polygon beside it that overlaps it."""
    moved = F.transform("ring", lambda p: F.struct((p["lon"] + shift).alias("lon"), p["lat"].alias("lat")))
    return polygons.union(polygons).union(polygons.withColumn("ring", moved))


@query("assign_watershed_repeated", f"""WITH {RINGS_SQL}, {CELLS_SQL}, pts AS (SELECT id AS point_id, lon, lat FROM cell),
part AS (SELECT k, i, x1, y1, x2, y2, 0 AS part FROM edge UNION ALL SELECT k, i, x1 + 0.01e0, y1, x2 + 0.01e0, y2, 1 FROM edge),
hit AS (SELECT point_id, k, part FROM pts, part GROUP BY ALL HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1)
SELECT point_id, min(lpad(CAST(k AS VARCHAR), 8, '0')) AS huc_id FROM hit GROUP BY 1""")
def _(t):
    return spatial.assign_watershed(_points(t), _twice(t.hucs(), 0.01)).select("point_id", "huc_id")


@query("zonal_mean_repeated", f"""WITH {RINGS_SQL}, {CELLS_SQL},
part AS (SELECT k, i, x1, y1, x2, y2, 0 AS part FROM edge UNION ALL SELECT k, i, x1 + 0.01e0, y1, x2 + 0.01e0, y2, 1 FROM edge),
hit AS (SELECT c.id, k, part, any_value(value) AS value FROM cell c, part WHERE value IS NOT NULL GROUP BY ALL
  HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1),
once AS (SELECT DISTINCT id, k, value FROM hit)
SELECT s_suppkey AS polygon_id, round(avg(value), 6) AS mean_value, CASE WHEN count(id) > 0 THEN count(id) END AS n_cells
FROM supplier LEFT JOIN once ON k = s_suppkey GROUP BY 1""")
def _(t):
    means = grids.zonal_mean(t.cells(), _twice(t.rings(), 0.01))
    return means.withColumn("mean_value", F.round("mean_value", 6))


@query("huc8_for_points", _assigned("AND huc_level = 8"))
def _(t):
    return spatial.huc_for_points(_points(t), t.hucs(), 8)


@query("huc6_for_points", _assigned("AND huc_level = 6"))
def _(t):
    return spatial.huc_for_points(_points(t), t.hucs(), 6)


@query("huc_code", """SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || upper(substring(s_name, 1, 2)) ELSE CAST(s_suppkey AS VARCHAR) END AS code FROM supplier""")
def _(t):
    level = F.when(F.col("s_nationkey") < 5, 4).otherwise(8)
    return t.supplier.select("s_suppkey", spatial.huc_code(level, F.lpad(F.col("s_nationkey").cast("string"), 2, "0"),
                                                           F.col("s_suppkey").cast("string"), F.col("s_name")).alias("code"))


@query("cells_near_polygon", f"{PAIRS_SQL} SELECT id, k AS polygon_id, value FROM pair WHERE value IS NOT NULL AND (inside OR d2 <= pow(0.0117e0, 2))")
def _(t):
    return grids.cells_near_polygon(t.cells(), t.rings(), 0.0117, keep=["id", "value"]).select("id", "polygon_id", "value")


@query("clip_cells", f"{PAIRS_SQL} SELECT id, k AS polygon_id, value FROM pair WHERE inside AND d2 > 0")
def _(t):
    return grids.clip_cells(t.cells(), t.rings()).select("id", "polygon_id", "value")


_MEETS = """least(x1, x2) <= lon + h AND greatest(x1, x2) >= lon - h AND least(y1, y2) <= lat + h AND greatest(y1, y2) >= lat - h
AND abs((y2 - y1) * (lon - x1) + (x1 - x2) * (lat - y1)) <= h * (abs(y2 - y1) + abs(x1 - x2))"""


@query("clip_cells_all_touched", f"""{PAIRS_SQL}, touched AS (SELECT DISTINCT id, k FROM cell, edge, (SELECT 0.0062e0 AS h) WHERE {_MEETS})
SELECT id, k AS polygon_id FROM pair WHERE inside AND d2 > 0 UNION SELECT id, k FROM touched""")
def _(t):
    cells = t.cells().select("id", "lat", "lon")
    return grids.clip_cells(cells, t.rings(), all_touched=True, half=(0.0062, 0.0062)).select("id", "polygon_id")


@query("zonal_mean", f"""{PAIRS_SQL} SELECT s_suppkey AS polygon_id, round(avg(value), 6) AS mean_value, nullif(count(value), 0) AS n_cells
FROM supplier LEFT JOIN pair ON k = s_suppkey AND inside AND d2 > 0 AND value IS NOT NULL GROUP BY 1""")
def _(t):
    return grids.zonal_mean(t.cells(), t.rings()).withColumn("mean_value", F.round("mean_value", 6))


_RING_INDEX = "CASE WHEN inside OR d2 = 0 THEN 0 ELSE CAST(ceil(round(sqrt(d2) / 0.025e0, 7)) AS BIGINT) END"


@query("zonal_mean_expanding", f"""{PAIRS_SQL}, r AS (SELECT k, {_RING_INDEX} AS ring, value FROM pair WHERE value IS NOT NULL AND (inside OR d2 <= 0.01e0)),
f AS (SELECT k, min(ring) AS ring FROM r GROUP BY 1)
SELECT s_suppkey AS polygon_id, round(avg(value), 6) AS mean_value, nullif(count(value), 0) AS n_cells, round(any_value(f.ring) * 0.025e0, 6) AS radius
FROM supplier LEFT JOIN f ON f.k = s_suppkey LEFT JOIN r ON r.k = f.k AND r.ring = f.ring GROUP BY 1""")
def _(t):
    return grids.zonal_mean_expanding(t.cells(), t.rings()).withColumns(
        {"mean_value": F.round("mean_value", 6), "radius": F.round("radius", 6)})


@query("spatial_mean_by_time", f"""{PAIRS_SQL} SELECT k AS polygon_id, {day_sql('ts')} AS ts, round(avg(value), 6) AS mean_value
FROM pair WHERE inside AND d2 > 0 GROUP BY 1, 2""")
def _(t):
    clipped = grids.clip_cells(t.cells(), t.rings(), keep=("ts", "value"))
    return grids.spatial_mean_by_time(clipped).withColumn("mean_value", F.round("mean_value", 6))


_SMALLER_SQL = RINGS_SQL.replace("outline(", "outline2(").replace(", outline)", ", outline2)").replace("vertex", "vertex2").replace(
    "edge AS", "edge2 AS").replace("0.02e0", "0.015e0")


@query("grid_iou", f"""{PAIRS_SQL}, {_SMALLER_SQL},
pair2 AS (SELECT c.id, e.k, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1 AS inside
  FROM cell c, edge2 e GROUP BY c.id, e.k)
SELECT s_suppkey AS polygon_id, iou FROM supplier LEFT JOIN (SELECT a.k, round(count(*) FILTER (WHERE a.inside AND b.inside) / count(*), 6) AS iou
  FROM pair a JOIN pair2 b USING (id, k) WHERE a.inside OR b.inside GROUP BY 1) ON k = s_suppkey""")
def _(t):
    k = F.col("polygon_id")
    cx = F.lit(-109) + (k * 7 % 700) / F.lit(100.0) + F.lit(0.00371)
    cy = F.lit(37) + (k * 3 % 400) / F.lit(100.0) + F.lit(0.00293)
    r = F.lit(0.015) + (k % 7) / F.lit(100.0)
    smaller = t.rings().select(k, F.array(*[F.struct((cx + F.lit(a) * r).alias("lon"), (cy + F.lit(b) * r).alias("lat"))
                                            for a, b in OUTLINE]).alias("ring"))
    out = grids.grid_iou(t.cells(), t.rings(), smaller, cell_id="id")
    return out.withColumn("iou", F.round("iou", 6))


# --- rings ------------------------------------------------------------------------

@query("polygon_bbox", f"""WITH {RINGS_SQL} SELECT k AS polygon_id, min(x) AS min_lon, min(y) AS min_lat, max(x) AS max_lon, max(y) AS max_lat FROM vertex GROUP BY 1""")
def _(t):
    return spatial.polygon_bbox(t.rings())


@query("intersects_bounds", f"""WITH {RINGS_SQL}, b AS (SELECT -106 AS x0, 38 AS y0, -105 AS x1b, 39 AS y1b),
e AS (SELECT k, bool_or(least(x1, x2) <= x1b AND greatest(x1, x2) >= x0 AND least(y1, y2) <= y1b AND greatest(y1, y2) >= y0
  AND abs((y2 - y1) * ((x0 + x1b) / 2 - x1) + (x1 - x2) * ((y0 + y1b) / 2 - y1)) <= abs(y2 - y1) * (x1b - x0) / 2 + abs(x1 - x2) * (y1b - y0) / 2) AS meets,
  count(*) FILTER (WHERE (y1 > y0) <> (y2 > y0) AND x1 + (y0 - y1) * (x2 - x1) / (y2 - y1) > x0) % 2 = 1 AS corner FROM edge, b GROUP BY 1)
SELECT k AS polygon_id, meets OR corner AS meets FROM e""")
def _(t):
    return t.rings().select("polygon_id", rings.intersects_bounds(F.col("ring"), (-106, 38, -105, 39)).alias("meets"))


@query("ring_contains", f"""WITH {RINGS_SQL}, c AS (SELECT k, avg(x) AS px, avg(y) + 0.011e0 AS py FROM vertex GROUP BY 1)
SELECT k AS polygon_id, count(*) FILTER (WHERE (y1 > py) <> (y2 > py) AND x1 + (py - y1) * (x2 - x1) / (y2 - y1) > px) % 2 = 1 AS inside
FROM edge JOIN c USING (k) GROUP BY 1""")
def _(t):
    ring = rings.close_ring(F.col("ring"))
    n = F.lit(float(len(OUTLINE)))
    px = F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["lon"]) / n
    py = F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["lat"]) / n + 0.011
    return t.rings().select("polygon_id", rings.ring_contains(ring, px, py).alias("inside"))


# A ring per order with integer corners that its keys decide, so that corners
# repeat, directions differ and some rings are closed already.
_CORNERS = (("o_orderkey % 3", "o_custkey % 3"), ("o_orderkey % 3", "o_custkey % 3 + o_orderkey % 2"), ("4 + o_custkey % 2", "o_orderkey % 5"),
            ("4 + o_custkey % 2", "o_orderkey % 5"), ("2", "6 - o_orderkey % 7"), ("o_orderkey % 2", "o_custkey % 3"))
_KEYS = "o_orderkey"
_CORNER_SQL = "corner AS (" + " UNION ALL ".join(
    f"SELECT {_KEYS}, {i} AS i, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM orders" for i, (x, y) in enumerate(_CORNERS)) + ")"
_CLEAN_SQL = f"""WITH {_CORNER_SQL},
d AS (SELECT * FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM corner WINDOW w AS (PARTITION BY {_KEYS} ORDER BY i)) WHERE i = 0 OR x <> px OR y <> py),
c AS (SELECT {_KEYS}, i, x, y FROM d UNION ALL SELECT {_KEYS}, 99, arg_min(x, i), arg_min(y, i) FROM d GROUP BY ALL
  HAVING arg_min(x, i) <> arg_max(x, i) OR arg_min(y, i) <> arg_max(y, i)),
e AS (SELECT *, row_number() OVER w AS seq, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM c WINDOW w AS (PARTITION BY {_KEYS} ORDER BY i)),
o AS (SELECT {_KEYS}, sum((x2 - x) * (y2 + y)) AS s, max(seq) AS n FROM e GROUP BY ALL)"""


def _corner_rings(t):
    points = [F.struct(F.expr(x).cast("double").alias("lon"), F.expr(y).cast("double").alias("lat")) for x, y in _CORNERS]
    return t.orders.select(_KEYS, F.array(*points).alias("ring"))


@query("clean_rings", f"""{_CLEAN_SQL} SELECT {_KEYS}, string_agg(CAST(CAST(x AS INT) AS VARCHAR) || ' ' || CAST(CAST(y AS INT) AS VARCHAR), ',' ORDER BY CASE WHEN s < 0 THEN seq ELSE n - seq END) AS ring
FROM e JOIN o USING ({_KEYS}) GROUP BY {_KEYS}""")
def _(t):
    shown = F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p["lon"].cast("int"), p["lat"].cast("int"))), ",")
    return rings.clean_rings(_corner_rings(t)).withColumn("ring", shown)


@query("ring_orientation", f"""{_CLEAN_SQL} SELECT {_KEYS}, s, s < 0 AS ccw FROM o""")
def _(t):
    closed = _corner_rings(t).withColumn("ring", rings.close_ring(rings.drop_repeats(F.col("ring"))))
    return closed.select(_KEYS, rings.orientation_sum(F.col("ring")).alias("s"), rings.is_ccw(F.col("ring")).alias("ccw"))


@query("outer_ring_vertices", f"WITH {RINGS_SQL} SELECT k AS polygon_id, i AS seq, x AS lon, y AS lat FROM vertex")
def _(t):
    multi = t.rings().select("polygon_id", rings.outer_ring(F.array("ring", F.reverse("ring"))).alias("ring"))
    return ring_vertices(multi, "polygon_id")


@query("ring_to_geojson", f"""WITH {RINGS_SQL} SELECT k AS polygon_id, i AS seq, x AS lon, y AS lat FROM vertex""")
def _(t):
    text = t.rings().select("polygon_id", nested.ring_to_geojson(F.col("ring")).alias("g"))
    return ring_vertices(text.select("polygon_id", nested.parse_geometry(F.col("g"))["ring"].alias("ring")), "polygon_id")


@query("parse_geometry", """SELECT event_id, CASE event_type WHEN 'view' THEN 'Point' WHEN 'click' THEN 'Polygon' END AS kind,
CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 4 END AS n FROM events""")
def _(t):
    v, e = F.col("value").cast("string"), F.col("event_type")
    doc = (F.when(e == "view", F.concat(F.lit('{"type":"Point","coordinates":['), v, F.lit(",40]}")))
           .when(e == "click", F.concat(F.lit('{"type":"Polygon","coordinates":[[[0,0],['), v, F.lit(",0],[1,1],[0,0]]]}")))
           .when(e == "error", F.concat(F.lit('{"coordinates":['), v, F.lit(",40]}")))
           .when(e == "purchase", F.lit('{"type":"Polygon","coordinates":"abc"}'))
           .otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":[[['), v)))
    g = nested.parse_geometry(doc)
    return t.events.select("event_id", g["type"].alias("kind"), F.size(g["ring"]).alias("n"))


def _wavy(t):
    """A ring of 120 vertices around each customer, with small waves on a square."""
    lat, lon = lattice(F.col("c_custkey"), 400, 700)

    def vertex(i):
        side, at = F.floor(i / 30), (i % 30) / 30.0
        wave = (i * (F.col("c_custkey") % 7 + 1) % 5) / 1000.0
        x = F.when(side == 0, at).when(side == 1, 1 - wave).when(side == 2, 1 - at).otherwise(wave)
        y = F.when(side == 0, wave).when(side == 1, at).when(side == 2, 1 - wave).otherwise(1 - at)
        return F.struct((lon + x).alias("lon"), (lat + y).alias("lat"))

    ring = dealt_out(t.customer.select("c_custkey")).select("c_custkey", F.transform(F.sequence(F.lit(0), F.lit(119)), vertex).alias("ring"))
    return ring.withColumn("ring", rings.close_ring(F.col("ring")))


@query("simplify_rings")
def _(t):
    return ring_vertices(simplify.simplify_rings(_wavy(t), 0.005), "c_custkey")


@query("simplify_rdp")
def _(t):
    return ring_vertices(simplify.simplify_rdp(_wavy(t), 0.002), "c_custkey")


# A square per customer with a bump in its lower side, higher than the tolerance for every other one.
_SQUARE = "'0.0 0.0,' || CASE WHEN c_custkey % 2 = 0 THEN (1 + c_custkey % 3) / 2.0e0 || ' -0.05,' ELSE '' END || s || ' 0.0,' || s || ' ' || s || ',0.0 ' || s || ',0.0 0.0'"


@query("simplify_bumped_squares", f"SELECT c_custkey, {_SQUARE} AS kept, {_SQUARE} AS kept_by_distance FROM (SELECT c_custkey, (1 + c_custkey % 3) || '.0' AS s FROM customer)")
def _(t):
    s = (F.lit(1) + F.col("c_custkey") % 3).cast("double")
    bump = F.when(F.col("c_custkey") % 2 == 0, -0.05).otherwise(-0.001)
    zero = F.lit(0.0)
    ring = F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in (
        (zero, zero), (s / 2, bump), (s, zero), (s, s), (zero, s), (zero, zero))])
    squares = t.customer.select("c_custkey", ring.alias("ring"))

    def text(df, name):
        return df.select("c_custkey", F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p["lon"], p["lat"])), ",").alias(name))

    return text(simplify.simplify_rings(squares, 0.01), "kept").join(
        text(simplify.simplify_rdp(squares, 0.01), "kept_by_distance"), "c_custkey")


# An open line per line item, flat but for one bump: kept only when it is high enough.
@query("simplify_rdp_lines", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN '0,3,9' ELSE '0,9' END AS xs FROM lineitem""")
def _(t):
    bump = F.when(F.col("l_quantity") > 25, 2.0).otherwise(0.25)
    line = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(
        i.cast("double").alias("lon"), F.when(i <= 3, bump * i / 3).otherwise(bump * (9 - i) / 6).alias("lat")))
    out = simplify.simplify_rdp(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", line.alias("ring")), 0.5)
    return out.select("l_orderkey", "l_linenumber", "l_partkey",
                      F.array_join(F.transform("ring", lambda p: p["lon"].cast("int").cast("string")), ",").alias("xs"))


# --- grids and granules -------------------------------------------------------------

_GROUPED = """grouped AS (SELECT o_orderkey AS id, o_custkey AS grid_id, 37 + (o_orderkey % 397) / 1e2 AS lat, -109 + (o_orderkey % 691) / 1e2 AS lon, o_totalprice AS value,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Metadata' WHEN '2-HIGH' THEN 'Soil_Moisture_Retrieval_Data_AM' ELSE 'Soil_Moisture_Retrieval_Data_PM' END AS grp,
  CAST(left(o_orderpriority, 1) AS INTEGER) AS group_order FROM orders)"""


def _grouped(t):
    p = F.col("o_orderpriority")
    lat, lon = lattice(F.col("o_orderkey"), 397, 691)
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grid_id"), lat.alias("lat"), lon.alias("lon"), F.col("o_totalprice").alias("value"),
        F.when(p == "1-URGENT", "Metadata").when(p == "2-HIGH", "Soil_Moisture_Retrieval_Data_AM").otherwise("Soil_Moisture_Retrieval_Data_PM").alias("grp"),
        F.substring(p, 1, 1).cast("int").alias("group_order"))


@query("first_group_cells", f"""WITH {_GROUPED} SELECT id, grid_id, grp FROM grouped g WHERE contains(grp, 'Soil_Moisture_Retrieval_Data')
AND group_order = (SELECT min(group_order) FROM grouped h WHERE h.grid_id = g.grid_id AND contains(grp, 'Soil_Moisture_Retrieval_Data'))""")
def _(t):
    return grids.first_group_cells(_grouped(t)).select("id", "grid_id", "grp")


@query("grid_bounds", f"""WITH {_GROUPED}, c AS (SELECT grid_id, grp, min(CASE WHEN value > 90000 THEN lon END) AS min_lon, min(CASE WHEN value > 90000 THEN lat END) AS min_lat,
  max(CASE WHEN value > 90000 THEN lon END) AS max_lon, max(CASE WHEN value > 90000 THEN lat END) AS max_lat FROM grouped GROUP BY 1, 2)
SELECT grid_id, grp, min_lon, min_lat, max_lon, max_lat FROM c WHERE min_lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY grp) = 1""")
def _(t):
    located = F.col("value") > 90000
    return grids.grid_bounds(_grouped(t).withColumns({"lat": F.when(located, F.col("lat")), "lon": F.when(located, F.col("lon"))}))


@query("grid_availability", f"""WITH {RINGS_SQL}, {CELLS_SQL}, box AS (SELECT k, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM vertex GROUP BY 1)
SELECT k AS polygon_id, grid_id, count(*) FILTER (WHERE i) AS total, count(*) FILTER (WHERE i AND value IS NOT NULL) AS valid, count(value) AS valid_around,
  round(count(*) FILTER (WHERE i AND value IS NOT NULL) * 100.0 / nullif(count(*) FILTER (WHERE i), 0), 6) AS pct_valid
FROM (SELECT *, lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 AS i FROM box LEFT JOIN cell ON lon BETWEEN x0 - 1 AND x1 + 1 AND lat BETWEEN y0 - 1 AND y1 + 1) GROUP BY 1, 2""")
def _(t):
    return grids.grid_availability(t.cells(), spatial.polygon_bbox(t.rings())).withColumn("pct_valid", F.round("pct_valid", 6))


@query("cells_with_coords", """SELECT o_orderkey, round(-110 + 0.25e0 * (o_orderkey % 100 + 0.5e0) + 0.01e0 * (o_custkey % 50 + 0.5e0), 9) AS lon,
round(42 + 0.02e0 * (o_orderkey % 100 + 0.5e0) - 0.5e0 * (o_custkey % 50 + 0.5e0), 9) AS lat FROM orders""")
def _(t):
    o = t.orders.select("o_orderkey", (F.col("o_orderkey") % 100).alias("col"), (F.col("o_custkey") % 50).alias("row"))
    placed = grids.cells_with_coords(o, (0.25, 0.01, -110, 0.02, -0.5, 42))
    return placed.select("o_orderkey", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


_GRANULE_SQL = """granule AS (SELECT c_custkey AS granule_id, -109 + (c_custkey % 700) / 1e2 AS x0, 37 + (c_custkey % 400) / 1e2 AS y0,
  -109 + (c_custkey % 700) / 1e2 + (c_custkey % 5) / 1e1 AS x1, 37 + (c_custkey % 400) / 1e2 + (c_custkey % 3) / 1e1 AS y1,
  DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS a, DATE '2024-01-01' + CAST(c_custkey % 20 + c_nationkey % 4 AS INTEGER) AS b, c_acctbal AS size_mb FROM customer)"""


def _granules(t):
    k = F.col("c_custkey")
    lat, lon = lattice(k, 400, 700)
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int"))
    return t.customer.select(
        k.alias("granule_id"), lon.alias("min_lon"), lat.alias("min_lat"), (lon + (k % 5) / 10.0).alias("max_lon"),
        (lat + (k % 3) / 10.0).alias("max_lat"), start.alias("start"), F.date_add(start, F.col("c_nationkey") % 4).alias("end"),
        F.col("c_acctbal").alias("size_mb"))


@query("granules_for", f"WITH {_GRANULE_SQL} SELECT granule_id FROM granule WHERE a <= DATE '2024-01-12' AND b >= DATE '2024-01-08' AND x0 <= -107.75 AND x1 >= -108.5 AND y0 <= 38.5 AND y1 >= 37.5")
def _(t):
    return filters.granules_for(_granules(t), (-108.5, 37.5, -107.75, 38.5), "2024-01-08", "2024-01-12").select("granule_id")


_REQUESTS_SQL = f"""WITH {RINGS_SQL}, {_GRANULE_SQL}, req AS (SELECT k AS request_id, min(x) AS rx0, min(y) AS ry0, max(x) AS rx1, max(y) AS ry1,
  DATE '2024-01-01' + CAST(k % 15 AS INTEGER) AS ra, DATE '2024-01-01' + CAST(k % 15 + 4 AS INTEGER) AS rb FROM vertex GROUP BY k),
hit AS (SELECT request_id, granule_id, size_mb FROM req, granule WHERE rx0 <= x1 AND x0 <= rx1 AND ry0 <= y1 AND y0 <= ry1 AND ra <= b AND a <= rb)"""


def _requests(t):
    k = F.col("polygon_id")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 15).cast("int"))
    return spatial.polygon_bbox(t.rings()).withColumns({"start": start, "end": F.date_add(start, 4)}).withColumnRenamed("polygon_id", "request_id")


@query("granules_for_requests", f"{_REQUESTS_SQL} SELECT request_id, granule_id FROM hit")
def _(t):
    return spatial.granules_for_requests(_requests(t), _granules(t)).select("request_id", "granule_id")


@query("smallest_granule_for_requests", f"{_REQUESTS_SQL} SELECT request_id, arg_min(granule_id, (size_mb, granule_id)) AS granule_id FROM hit GROUP BY 1")
def _(t):
    return filters.smallest_granule(spatial.granules_for_requests(_requests(t), _granules(t))).select("request_id", "granule_id")


@query("granules_for_requests_ts", f"""WITH {RINGS_SQL}, g AS (SELECT event_id AS granule_id, user_id AS u, -109 + (user_id % 700) / 1e2 AS x0, 37 + (user_id % 400) / 1e2 AS y0, ts AS a,
  CASE WHEN event_id % 50 = 0 THEN TIMESTAMP '9999-12-31 23:59:59' ELSE ts + to_hours(CAST(event_id % 60 AS INTEGER)) END AS b FROM events),
req AS (SELECT k AS request_id, min(x) AS rx0, min(y) AS ry0, max(x) AS rx1, max(y) AS ry1, TIMESTAMP '2024-01-05 07:30:00' + to_hours(CAST(k % 200 AS INTEGER)) AS ra,
  CASE WHEN k % 3 = 0 THEN TIMESTAMP '2031-01-01 00:00:00' ELSE TIMESTAMP '2024-01-05 07:30:00' + to_hours(CAST(k % 200 + k % 7 AS INTEGER)) END AS rb FROM vertex GROUP BY k)
SELECT request_id, granule_id FROM req, g WHERE rx0 <= x0 + 0.2e0 AND x0 <= rx1 AND ry0 <= y0 + 0.1e0 AND y0 <= ry1 AND ra <= b AND a <= rb""")
def _(t):
    """Ranges with times of day, of hours, of years and without an end."""
    u = F.col("user_id")
    lon, lat = F.lit(-109) + (u % 700) / F.lit(100.0), F.lit(37) + (u % 400) / F.lit(100.0)
    end = F.when(F.col("event_id") % 50 == 0, F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")).otherwise(
        F.expr("CAST(ts AS timestamp_ntz) + make_dt_interval(0, CAST(event_id % 60 AS INT))"))
    granules = t.events.select(F.col("event_id").alias("granule_id"), lon.alias("min_lon"), lat.alias("min_lat"), (lon + 0.2).alias("max_lon"),
                               (lat + 0.1).alias("max_lat"), F.col("ts").cast("timestamp_ntz").alias("start"), end.alias("end"))
    start = F.expr("TIMESTAMP_NTZ '2024-01-05 07:30:00' + make_dt_interval(0, CAST(polygon_id % 200 AS INT))")
    stop = F.when(F.col("polygon_id") % 3 == 0, F.lit("2031-01-01 00:00:00").cast("timestamp_ntz")).otherwise(
        F.expr("TIMESTAMP_NTZ '2024-01-05 07:30:00' + make_dt_interval(0, CAST(polygon_id % 200 + polygon_id % 7 AS INT))"))
    requests = spatial.polygon_bbox(t.rings()).select(F.col("polygon_id").alias("request_id"), "min_lon", "min_lat", "max_lon", "max_lat",
                                                      start.alias("start"), stop.alias("end"))
    return spatial.granules_for_requests(requests, granules).select("request_id", "granule_id")
