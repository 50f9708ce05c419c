"""The end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import OUTLINE, RINGS_SQL, day_sql, lattice, query
from checks.core import KM
from checks.landed import _SWE_SQL, _swe_docs
from checks.spatial import _GRANULE_SQL, _MEETS, _granules
from freshet.functions import rings
from freshet.operators import flows, series, simplify
from freshet.plans import dataset, forecast, watershed
from freshet.sources import snow as snow_source

# --- dataset ------------------------------------------------------------------------
# Suppliers are the sites, with gauge readings from the user of the same number and
# weather from customers; dates of orders are moved to the years before 2024.

_SHIFT = 7900
_KEY_SQL = "CASE WHEN {k} % 2 = 0 THEN 'USGS' ELSE 'DWR' END"
_BUILD_SQL = f"""WITH site AS (SELECT CASE WHEN s_nationkey = 3 THEN 'NOAA' ELSE {_KEY_SQL.format(k='s_suppkey')} END AS prefix, CAST(s_suppkey AS VARCHAR) AS site_id,
  37 + (s_suppkey % 400) / 1e2 AS slat, -109 + (s_suppkey % 700) / 1e2 AS slon FROM supplier),
known AS (SELECT *, prefix || ':' || site_id AS station_id FROM site WHERE prefix <> 'NOAA'),
wx AS (SELECT 'USW' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS wx_id, 37 + (c_custkey % 400) / 1e2 AS lat, -109 + (c_custkey % 700) / 1e2 AS lon FROM customer WHERE c_mktsegment <> 'MACHINERY'),
o AS (SELECT *, 'USW' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS wx_id, CAST(o_orderdate AS DATE) + {_SHIFT} AS d FROM orders),
fit AS (SELECT wx_id FROM o GROUP BY 1 HAVING max(o_totalprice) / 500000e0 > 0.87 AND (max(d) >= DATE '2024-02-01' OR max(d) >= DATE '2017-02-02' - 3) AND min(d) <= DATE '2017-02-02'
  AND count(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus IN ('F', 'O')) = 2),
h AS (SELECT station_id, site_id, wx_id, least(1, greatest(0, pow(sin((radians(lat) - radians(slat)) / 2), 2)
  + cos(radians(slat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(slon)) / 2), 2))) AS h FROM known, wx),
near AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round({KM}, 6), wx_id) AS rank FROM h QUALIFY rank <= 50),
best AS (SELECT station_id, site_id, arg_min(wx_id, rank) AS noaa_station FROM near WHERE wx_id IN (SELECT wx_id FROM fit) GROUP BY 1, 2),
days AS (SELECT wx_id AS noaa_station, d AS date, min(o_totalprice) AS tmin, max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS tmax FROM o GROUP BY 1, 2),
w AS (SELECT station_id, date, tmin, tmax, noaa_station, site_id AS usgs_site_id FROM best JOIN days USING (noaa_station) WHERE date BETWEEN DATE '2017-02-02' AND DATE '2024-02-01'),
f AS (SELECT {_KEY_SQL.format(k='user_id')} || ':' || user_id AS station_id, CAST(ts AS DATE) AS date, min(value) AS min_flow, max(value) AS max_flow FROM events GROUP BY 1, 2),
fk AS (SELECT * FROM f WHERE station_id IN (SELECT station_id FROM known)),
m AS (SELECT * FROM (SELECT * FROM w WHERE station_id IN (SELECT station_id FROM fk)) FULL JOIN (SELECT * FROM fk WHERE station_id IN (SELECT station_id FROM w)) USING (station_id, date))"""


def _sources(t):
    def keyed(k):
        return F.when(k % 2 == 0, "USGS").otherwise("DWR")

    lat, lon = lattice(F.col("s_suppkey"), 400, 700)
    prefix = keyed(F.col("s_suppkey"))
    moved = t.orders.select(F.concat(F.lit("USW"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("wx"),
                            F.date_add(F.to_date("o_orderdate"), _SHIFT).alias("d"), "o_totalprice", "o_orderstatus")
    return dataset.Sources(
        sites=t.supplier.select(F.concat(F.when(F.col("s_nationkey") == 3, "NOAA").otherwise(prefix), F.lit(":"), F.col("s_suppkey").cast("string")).alias("value")),
        coordinates=t.supplier.select(prefix.alias("prefix"), F.col("s_suppkey").cast("string").alias("site_id"), lat.alias("lat"), lon.alias("lon")),
        readings=t.events.select(keyed(F.col("user_id")).alias("prefix"), F.col("user_id").cast("string").alias("station_id"), "ts", F.col("value").alias("flow")),
        wx_stations=t.wx_stations(),
        wx_meta=moved.groupBy(F.col("wx").alias("wx_id")).agg((F.max("o_totalprice") / 500000.0).alias("datacoverage"), F.min("d").alias("mindate"), F.max("d").alias("maxdate")),
        wx_fields=t.wx_fields(),
        wx_daily=moved.groupBy(F.col("wx").alias("noaa_station"), F.col("d").alias("date")).agg(
            F.min("o_totalprice").alias("tmin"), F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("tmax")))


_VALUES = ("tmin", "tmax", "min_flow", "max_flow")


@query("build_dataset", f"{_BUILD_SQL} SELECT {day_sql('date')} AS date, station_id, "
       + ", ".join(f"round(coalesce({c}, avg({c}) OVER (PARTITION BY station_id)), 6) AS {c}" for c in _VALUES) + ", noaa_station, usgs_site_id FROM m")
def _(t):
    combined, _ = dataset.build_dataset(_sources(t), "2024-02-01")
    return combined.withColumns({c: F.round(c, 6) for c in _VALUES})


@query("build_dataset_rejects", f"""{_BUILD_SQL} SELECT prefix || ':' || site_id AS station_id, 'unknown prefix' AS reason FROM site WHERE prefix = 'NOAA'
UNION ALL SELECT station_id, CASE WHEN station_id IN (SELECT station_id FROM w) THEN 'no flow' WHEN station_id IN (SELECT station_id FROM fk) THEN 'no weather' ELSE 'no data' END
FROM known WHERE station_id NOT IN (SELECT station_id FROM w) OR station_id NOT IN (SELECT station_id FROM fk)""")
def _(t):
    return dataset.build_dataset(_sources(t), "2024-02-01")[1]


_TYPES = ("click", "error", "purchase", "signup", "view")
_NW = "PARTITION BY station_id ORDER BY date"
_NORM_STEPS = []
for _name, _expr in (
        ("r", f"avg({{c}}) OVER ({_NW} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"),
        ("b", f"coalesce({{c}}, first_value({{c}} IGNORE NULLS) OVER ({_NW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"),
        ("k", f"coalesce({{c}}, last_value({{c}} IGNORE NULLS) OVER ({_NW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")):
    _NORM_STEPS.append(f"{_name} AS (SELECT station_id, date, {', '.join(_expr.format(c=c) + ' AS ' + c for c in ('tmin', 'tmax'))}, min_flow, max_flow FROM "
                       + {"r": "n0", "b": "r", "k": "b"}[_name] + ")")
_NORMALIZE_SQL = f"""WITH n0 AS (SELECT event_type AS station_id, CAST(ts AS DATE) AS date, CASE WHEN min(value) > 0.4 THEN min(value) END AS tmin, CASE WHEN max(value) < 75 THEN max(value) END AS tmax,
  CASE WHEN count(*) > 40 THEN min(value) END AS min_flow, max(value) AS max_flow FROM events GROUP BY 1, 2), {', '.join(_NORM_STEPS)},
x AS (SELECT station_id, date, {', '.join(f'coalesce({c}, avg({c}) OVER ()) AS {c}' for c in _VALUES)} FROM k)
SELECT {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}' for c in _VALUES)}, {', '.join(f"station_id = '{v}' AS station_{v}" for v in _TYPES)},
round((dayofyear(date) - 1) / 366, 6) AS date_normalized FROM x"""


def _combined_by_type(t):
    d = t.events.groupBy(F.col("event_type").alias("station_id"), F.to_date("ts").alias("date")).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    return d.select("station_id", "date", F.when(F.col("lo") > 0.4, F.col("lo")).alias("tmin"), F.when(F.col("hi") < 75, F.col("hi")).alias("tmax"),
                    F.when(F.col("n") > 40, F.col("lo")).alias("min_flow"), F.col("hi").alias("max_flow"))


@query("normalize", _NORMALIZE_SQL)
def _(t):
    out = dataset.normalize(_combined_by_type(t), station_values=_TYPES)
    return out.withColumns({c: F.round(c, 6) for c in (*_VALUES, "date_normalized")})


@query("normalize_many_stations", """WITH n0 AS (SELECT o_custkey AS station_id, CAST(o_orderdate AS DATE) AS date, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1, 2)
SELECT CAST(station_id AS VARCHAR) AS station_id, strftime(date, '%Y-%m-%d') AS date, round((lo - avg(lo) OVER ()) / stddev_pop(lo) OVER (), 6) AS min_flow,
round((hi - avg(hi) OVER ()) / stddev_pop(hi) OVER (), 6) AS max_flow, true AS index_fits FROM n0""")
def _(t):
    """Thousands of stations, each with its own position in place of a column."""
    n = t.orders.select("o_custkey").distinct().count()
    days = t.orders.groupBy(F.col("o_custkey").cast("string").alias("station_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.min("o_totalprice").alias("min_flow"), F.max("o_totalprice").alias("max_flow")).withColumns(
        {"tmin": F.lit(1.0), "tmax": F.lit(2.0)})
    out = dataset.normalize(days, keep_keys=True)
    return out.select("station_id", "date", F.round("min_flow", 6).alias("min_flow"), F.round("max_flow", 6).alias("max_flow"),
                      F.col("station_index").between(0, n - 1).alias("index_fits"))


@query("fit_forecaster")
def _(t):
    daily = flows.daily_extremes(t.readings())
    windows = series.sliding_windows(daily, history=4, forecast=2, horizon=2, features=["min_flow", "max_flow"])
    scores = forecast.fit_forecaster(windows, horizon=2).scores
    return t.spark.createDataFrame(sorted(scores.items()), "target string, mse double")


# --- watershed jobs -------------------------------------------------------------------

# The rings of the suppliers with a vertex between any two corners, off the line by less than the
# tolerance, but for the third of every third ring: simplifying leaves the corners and that one.
TOLERANCE = 0.005
BUMPED_SQL = f"""{RINGS_SQL},
bumped AS (SELECT k, 2 * i AS i, x, y, true AS kept FROM vertex UNION ALL
  SELECT a.k, 2 * a.i + 1, (a.x + b.x) / 2 + CASE WHEN a.i = 2 AND a.k % 3 = 0 THEN 0.012e0 ELSE 0.0011e0 END, (a.y + b.y) / 2 - 0.0007e0, a.i = 2 AND a.k % 3 = 0
  FROM vertex a JOIN vertex b ON a.k = b.k AND b.i = (a.i + 1) % {len(OUTLINE)}),
raw AS (SELECT k, i, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM bumped WINDOW w AS (PARTITION BY k ORDER BY i)),
reduced AS (SELECT k, i, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM bumped WHERE kept WINDOW w AS (PARTITION BY k ORDER BY i))"""


def bumped_rings(t):
    """(polygon_id, ring) of ``BUMPED_SQL``."""
    corners = len(OUTLINE)

    def between(i):
        a, b = F.get("ring", F.lit(i)), F.get("ring", F.lit((i + 1) % corners))
        high = F.when(F.col("polygon_id") % 3 == 0, 0.012).otherwise(0.0011) if i == 2 else F.lit(0.0011)
        return F.struct(((a["lon"] + b["lon"]) / 2 + high).alias("lon"), ((a["lat"] + b["lat"]) / 2 - F.lit(0.0007)).alias("lat"))

    return t.rings().select("polygon_id", F.array(*[p for i in range(corners) for p in (F.get("ring", F.lit(i)), between(i))]).alias("ring"))


def bumped_hucs(t):
    """The watersheds with the rings of ``BUMPED_SQL``."""
    rings = bumped_rings(t).select(F.lpad(F.col("polygon_id").cast("string"), 8, "0").alias("huc_id"), "ring")
    return t.hucs().drop("ring").join(rings, "huc_id")


MATCH_BUMPED_SQL = f"""WITH {BUMPED_SQL}, {_GRANULE_SQL}, huc AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS huc_id, s_name AS name FROM supplier WHERE s_nationkey >= 10),
pt AS (SELECT c_custkey AS point_id, 37 + (c_custkey % 400) / 1e2 AS lat, -109 + (c_custkey % 700) / 1e2 AS lon FROM customer),
hit AS (SELECT point_id, k, lat, lon FROM pt, raw GROUP BY ALL HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1),
found AS (SELECT point_id, lon, lat, min(huc_id) AS huc_id, arg_min(name, huc_id) AS name FROM hit JOIN huc USING (k) GROUP BY ALL),
used AS (SELECT k, huc_id FROM huc WHERE huc_id IN (SELECT huc_id FROM found)),
re AS (SELECT k, huc_id, round_even(x1, 6) AS x1, round_even(y1, 6) AS y1, round_even(x2, 6) AS x2, round_even(y2, 6) AS y2 FROM reduced JOIN used USING (k))"""


def _pts(t):
    lat, lon = lattice(F.col("c_custkey"), 400, 700)
    return t.customer.select(F.col("c_custkey").alias("point_id"), lat.alias("lat"), lon.alias("lon"))


@query("huc_boundary", f"""{MATCH_BUMPED_SQL}, e AS (SELECT huc_id, count(*) + 1 AS n, bool_or(least(x1, x2) <= -105 AND greatest(x1, x2) >= -107 AND least(y1, y2) <= 39 AND greatest(y1, y2) >= 38
  AND abs((y2 - y1) * (-106 - x1) + (x1 - x2) * (38.5 - y1)) <= abs(y2 - y1) * 1 + abs(x1 - x2) * 0.5) AS meets,
  count(*) FILTER (WHERE (y1 > 38) <> (y2 > 38) AND x1 + (38 - y1) * (x2 - x1) / (y2 - y1) > -107) % 2 = 1 AS corner FROM re GROUP BY 1)
SELECT point_id, lon, lat, huc_id, name, n AS n_vertices, meets OR corner AS meets_bounds FROM found JOIN e USING (huc_id)""")
def _(t):
    out = watershed.huc_boundary(_pts(t), bumped_hucs(t), 8, bounds=(-107, 38, -105, 39), tolerance=TOLERANCE)
    return out.withColumn("n_vertices", F.size("ring").cast("long")).drop("ring")


# Corners turn counter-clockwise and end where they began; numbers as both engines write them, by micro-degrees.
_RING_SQL = "string_agg(CAST(round(x1 * 1e6) AS BIGINT) || ' ' || CAST(round(y1 * 1e6) AS BIGINT), ',' ORDER BY i)"


@query("huc_boundary_simplified", f"""{MATCH_BUMPED_SQL}, r AS (SELECT lpad(CAST(k AS VARCHAR), 8, '0') AS huc_id, count(*) + 1 AS n_vertices, {_RING_SQL} AS ring FROM reduced GROUP BY k)
SELECT point_id, huc_id, n_vertices, ring FROM found JOIN r USING (huc_id)""")
def _(t):
    out = watershed.huc_boundary(_pts(t), bumped_hucs(t), 8, tolerance=TOLERANCE)
    return out.select("point_id", "huc_id", F.size("ring").cast("long").alias("n_vertices"), _ring_text("ring").alias("ring"))


def _ring_text(ring):
    """A closed ring but for its last point, counter-clockwise rings from their first corner on."""
    turned = F.slice(F.col(ring), 1, F.size(ring) - 1)
    micro = lambda c: F.round(c * 1e6).cast("long").cast("string")
    return F.array_join(F.transform(turned, lambda p: F.concat_ws(" ", micro(p["lon"]), micro(p["lat"]))), ",")


@query("simplify_rings_kept", f"WITH {BUMPED_SQL} SELECT k AS polygon_id, {_RING_SQL} AS ring FROM reduced GROUP BY k")
def _(t):
    """Closed rings whose kept vertices follow from their keys, by the distance from segments."""
    out = simplify.simplify_rings(bumped_rings(t), TOLERANCE)
    return out.select("polygon_id", _ring_text("ring").alias("ring"))


@query("simplify_rdp_kept", f"WITH {BUMPED_SQL} SELECT k AS polygon_id, {_RING_SQL} AS ring FROM reduced GROUP BY k")
def _(t):
    """The same rings by the distance from chords' lines, closed before."""
    out = simplify.simplify_rdp(bumped_rings(t).withColumn("ring", rings.close_ring(F.col("ring"))), TOLERANCE)
    return out.select("polygon_id", _ring_text("ring").alias("ring"))


_SEG = "greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2))))"


@query("huc_soil_moisture", f"""{MATCH_BUMPED_SQL}, req AS (SELECT huc_id, min(x1) AS rx0, min(y1) AS ry0, max(x1) AS rx1, max(y1) AS ry1 FROM re GROUP BY 1),
g AS (SELECT huc_id, arg_min(granule_id, (size_mb, granule_id)) AS granule_id FROM req, granule WHERE rx0 <= x1 AND x0 <= rx1 AND ry0 <= y1 AND y0 <= ry1
  AND a <= DATE '2024-01-15' AND b >= DATE '2024-01-10' GROUP BY 1),
c AS (SELECT o_custkey AS granule_id, o_orderkey AS id, 37 + (o_custkey % 400) / 1e2 + (o_orderkey % 20) / 1e2 AS lat, -109 + (o_custkey % 700) / 1e2 + (o_orderkey % 30) / 1e2 AS lon, floor(o_totalprice) AS value
  FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT huc_id, id, any_value(granule_id) AS granule_id, any_value(value) AS value, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1 AS inside,
  min(sqrt(pow(lon - (x1 + {_SEG} * (x2 - x1)), 2) + pow(lat - (y1 + {_SEG} * (y2 - y1)), 2))) AS d FROM g JOIN c USING (granule_id) JOIN re USING (huc_id) GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN inside THEN 0 ELSE CAST(ceil(round(d / 0.025e0, 7)) AS BIGINT) END AS ring FROM p WHERE inside OR d <= 0.1),
m AS (SELECT huc_id, round(avg(value), 6) AS mean_value, count(*) AS n_cells, round(any_value(ring) * 0.025e0, 6) AS radius FROM r JOIN (SELECT huc_id, min(ring) AS ring FROM r GROUP BY 1) USING (huc_id, ring) GROUP BY 1)
SELECT point_id, lon, lat, huc_id, name, granule_id, mean_value, n_cells, radius FROM found LEFT JOIN g USING (huc_id) LEFT JOIN m USING (huc_id)""")
def _(t):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    cells = t.orders.select(k.alias("grid_id"), (37 + (k % 400) / 100.0 + (o % 20) / 100.0).alias("lat"), (-109 + (k % 700) / 100.0 + (o % 30) / 100.0).alias("lon"),
                            F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("double")).alias("value"))
    out = watershed.huc_soil_moisture(_pts(t), bumped_hucs(t), _granules(t), cells, "2024-01-10", "2024-01-15", tolerance=TOLERANCE)
    return out.withColumns({"mean_value": F.round("mean_value", 6), "radius": F.round("radius", 6)})


@query("huc_drought_cells", f"""{MATCH_BUMPED_SQL}, c AS (SELECT o_orderkey AS id, 41.0007e0 - 0.01e0 * ((o_orderkey % 397) + 0.5e0) AS lat, -109.0003e0 + 0.01e0 * ((o_orderkey % 691) + 0.5e0) AS lon, o_totalprice AS value FROM orders)
SELECT huc_id AS polygon_id, round(lat, 6) AS latitude, round(lon, 6) AS longitude, value FROM c, re GROUP BY huc_id, id, lat, lon, value
HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1""")
def _(t):
    cells = t.orders.select((F.col("o_orderkey") % 397).alias("row"), (F.col("o_orderkey") % 691).alias("col"), F.col("o_totalprice").alias("value"))
    out = watershed.huc_drought_cells(_pts(t), bumped_hucs(t), cells, (0.01, 0, -109.0003, 0, -0.01, 41.0007), tolerance=TOLERANCE)
    return out.withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})


@query("huc_moisture_series", f"""{MATCH_BUMPED_SQL}, c AS (SELECT o_orderkey AS id, 37 + (o_orderkey % 397) / 1e2 AS lat, -109 + (o_orderkey % 691) / 1e2 AS lon, CAST(o_orderdate AS DATE) AS ts,
  CASE WHEN o_totalprice >= 20000 THEN floor(o_totalprice) END AS value FROM orders WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
p AS (SELECT huc_id, id, ts, value, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1 AS inside, bool_or({_MEETS}) AS touched
  FROM c, re, (SELECT 0.0062e0 AS h) GROUP BY 1, 2, 3, 4)
SELECT huc_id AS polygon_id, {day_sql('ts')} AS ts, round(avg(value), 6) AS mean_value FROM p WHERE inside OR touched GROUP BY 1, 2""")
def _(t):
    out = watershed.huc_moisture_series(_pts(t), bumped_hucs(t), t.cells(), "1996-01-01", "2000-12-31", (0.0062, 0.0062), tolerance=TOLERANCE)
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query("basin_snow", f"""{_SWE_SQL}, b AS (SELECT row_number() OVER () - 1 AS i, n FROM (SELECT unnest([{', '.join("'" + b + "'" for b in snow_source.BASINS)}]) AS n))
SELECT n AS basin_name, 'basin' AS basin_type, y || '-' || month_day AS date, swe FROM d JOIN b ON CAST(basin AS BIGINT) % 8 = i WHERE y || '-' || month_day BETWEEN '1996-01-01' AND '2000-12-31'""")
def _(t):
    # Customers are spread over the eight basins, whose snow tables come by file name.
    names = snow_source.BASINS
    stems = F.array(*[F.lit(snow_source.source_file(b).rsplit(".", 1)[0]) for b in names])
    wide = snow_source.parse_swe_wide(_swe_docs(t).withColumn("basin", F.get(stems, (F.col("basin").cast("long") % len(names)).cast("int"))))
    dim = snow_source.basin_dim(t.spark, "/landed")
    asked = dim.where(F.col("basin_type") == "basin").select(F.col("basin").alias("basin_name"), "basin_type")
    return watershed.basin_snow(asked, dim, wide, "1996-01-01", "2000-12-31")
