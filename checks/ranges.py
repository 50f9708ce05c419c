"""Ranges of dates over timestamps, and a granule catalogue landed as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import PAIRS_SQL, RINGS_SQL, query
from checks.jobs import MATCH_BUMPED_SQL, TOLERANCE, _pts, bumped_hucs
from checks.spatial import _MEETS
from freshet.operators import filters, spatial
from freshet.plans import watershed
from freshet.operators.staging import new_folder
from freshet.sources import grids, watershed as watershed_source
from freshet.sources.watershed import ring_vertices

# --- the last day of a range ------------------------------------------------------------


@query("date_range_timestamps", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'")
def _(t):
    return filters.date_range(t.events, "2024-01-05", "2024-01-20", date="ts").select("event_id")


@query("date_range_moments", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-20 18:00:00'")
def _(t):
    return filters.date_range(t.events, "2024-01-05 06:30:00", "2024-01-20 18:00:00", date="ts").select("event_id")


_EVENT_GRANULES_SQL = """g AS (SELECT event_id AS granule_id, -109 + (user_id % 700) / 1e2 AS x0, 37 + (user_id % 400) / 1e2 AS y0, ts AS a, ts + INTERVAL 5 HOUR AS b FROM events)"""


def _event_granules(t):
    u = F.col("user_id")
    lon, lat = F.lit(-109) + (u % 700) / F.lit(100.0), F.lit(37) + (u % 400) / F.lit(100.0)
    return t.events.select(F.col("event_id").alias("granule_id"), lon.alias("min_lon"), lat.alias("min_lat"), (lon + 0.2).alias("max_lon"),
                           (lat + 0.1).alias("max_lat"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 5 HOURS")).alias("end"),
                           (F.col("event_id") % 100 / F.lit(10.0)).alias("size_mb"))


@query("granules_for_timestamps", f"""WITH {_EVENT_GRANULES_SQL} SELECT granule_id FROM g WHERE a < TIMESTAMP '2024-01-13' AND b >= TIMESTAMP '2024-01-08'
  AND x0 <= -104 AND x0 + 0.2e0 >= -108.5 AND y0 <= 40 AND y0 + 0.1e0 >= 37.5""")
def _(t):
    return filters.granules_for(_event_granules(t), (-108.5, 37.5, -104, 40), "2024-01-08", "2024-01-12").select("granule_id")


@query("granules_for_requests_by_day", f"""WITH {RINGS_SQL}, {_EVENT_GRANULES_SQL}, req AS (SELECT k AS request_id, min(x) AS rx0, min(y) AS ry0, max(x) AS rx1, max(y) AS ry1,
  DATE '2024-01-01' + CAST(k % 15 AS INTEGER) AS ra, DATE '2024-01-01' + CAST(k % 15 + k % 3 AS INTEGER) AS rb FROM vertex GROUP BY k)
SELECT request_id, granule_id FROM req, g WHERE rx0 <= x0 + 0.2e0 AND x0 <= rx1 AND ry0 <= y0 + 0.1e0 AND y0 <= ry1 AND ra <= b AND a < rb + INTERVAL 1 DAY""")
def _(t):
    """Requests by whole days against granules with times of day."""
    k = F.col("polygon_id")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 15).cast("int"))
    requests = spatial.polygon_bbox(t.rings()).withColumns({"start": start, "end": F.date_add(start, (k % 3).cast("int"))}).withColumnRenamed("polygon_id", "request_id")
    return spatial.granules_for_requests(requests, _event_granules(t)).select("request_id", "granule_id")


@query("latest_scene_timestamps", """SELECT event_type AS dataset, CAST(max(ts) AS VARCHAR)[1:19] AS taken FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1""")
def _(t):
    scenes = t.events.select(F.col("event_type").alias("dataset"), F.col("event_id").cast("string").alias("scene_id"), F.col("ts").alias("acquisition_date"))
    return filters.latest_scene(scenes, "2024-01-15", 14).select("dataset", F.date_format("acquisition_date", "yyyy-MM-dd HH:mm:ss").alias("taken"))


_HOURS_SQL = """c AS (SELECT event_id AS id, 37 + (event_id % 397) / 1e2 AS lat, -109 + (event_id % 691) / 1e2 AS lon, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-08')"""


@query("huc_moisture_series_timestamps", f"""{MATCH_BUMPED_SQL}, {_HOURS_SQL},
p AS (SELECT huc_id, id, ts, value, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1 AS inside, bool_or({_MEETS}) AS touched
  FROM c, re, (SELECT 0.0062e0 AS h) GROUP BY 1, 2, 3, 4)
SELECT huc_id AS polygon_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(avg(value), 6) AS mean_value FROM p WHERE inside OR touched GROUP BY 1, 2""")
def _(t):
    """Cells with times of day, the last day of the range whole."""
    lat, lon = F.lit(37) + (F.col("event_id") % 397) / F.lit(100.0), F.lit(-109) + (F.col("event_id") % 691) / F.lit(100.0)
    cells = t.events.select(F.col("event_id").alias("id"), lat.alias("lat"), lon.alias("lon"), F.date_trunc("hour", "ts").alias("ts"), "value")
    out = watershed.huc_moisture_series(_pts(t), bumped_hucs(t), cells, "2024-01-03", "2024-01-07", (0.0062, 0.0062), tolerance=TOLERANCE)
    return out.withColumn("mean_value", F.round("mean_value", 6))


# --- a catalogue as it lands --------------------------------------------------------------

# Starts come without a zone, with one, as days and broken; a size may be words, a box reversed, an id blank.
_LANDED_SQL = """landed AS (SELECT event_id AS e, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'G' || event_id END AS granule_id, user_id % 90 AS x, ts,
  event_id % 4 AS kind, event_id % 20 = 3 AS broken, event_id % 13 = 0 AS words, event_id % 19 = 0 AS reversed FROM events),
g AS (SELECT *, CASE kind WHEN 1 THEN date_trunc('second', ts) + INTERVAL 7 HOUR WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS a,
  CASE kind WHEN 2 THEN date_trunc('day', ts) + INTERVAL 86399 SECOND ELSE date_trunc('second', ts) + INTERVAL 12 HOUR END AS b FROM landed)"""


def _landed_granules(t):
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp_ntz")
    second = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    start = (F.when(e % 20 == 3, "2024-13-41").when(e % 4 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-07:00")))
             .when(e % 4 == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise(second))
    end = F.when(e % 4 == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts + F.expr("INTERVAL 12 HOURS"), "yyyy-MM-dd HH:mm:ss'Z'"))
    x = F.col("user_id") % 90
    rows = t.events.select(
        F.when(e % 17 == 0, " ").otherwise(F.concat(F.lit("G"), e.cast("string"))).alias("granule_id"), x.cast("string").alias("min_lon"),
        F.lit(37).alias("min_lat"), F.when(e % 19 == 0, x - 1).otherwise(x + 1).alias("max_lon"), F.lit("38.5 ").alias("max_lat"),
        start.alias("start"), end.alias("end"), F.when(e % 13 == 0, "unknown").otherwise((e % 100).cast("string")).alias("size_mb"))
    return grids.parse_granules(rows)


@query("landed_granules", f"""WITH {_LANDED_SQL} SELECT granule_id, CAST(x AS DOUBLE) AS min_lon, 38.5e0 AS max_lat, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS "end",
  CAST(e % 100 AS DOUBLE) AS size_mb FROM g WHERE granule_id IS NOT NULL AND NOT broken AND NOT words AND NOT reversed AND a <= b""")
def _(t):
    return _landed_granules(t)[0].select("granule_id", "min_lon", "max_lat", "start", "end", "size_mb")


@query("landed_granules_rejected", f"""WITH {_LANDED_SQL}, r AS (SELECT granule_id, concat_ws(',', CASE WHEN broken THEN 'start' END, CASE WHEN words THEN 'size_mb' END,
  CASE WHEN granule_id IS NULL THEN 'granule_id' END, CASE WHEN reversed THEN 'max_lon' END, CASE WHEN NOT broken AND a > b THEN 'end' END) AS reason, e FROM g)
SELECT granule_id, reason FROM r WHERE reason <> ''""")
def _(t):
    return _landed_granules(t)[1].select("granule_id", "reason")


# --- points to the region of level 4 ------------------------------------------------------------

@query("huc4_for_points", f"""{PAIRS_SQL}, h AS (SELECT s_suppkey AS k, s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS huc_id FROM supplier WHERE s_nationkey < 5)
SELECT id AS point_id, arg_min(huc_id, huc_id) AS huc_id, arg_min(name, huc_id) AS name FROM pair JOIN h USING (k) WHERE inside AND d2 > 0 GROUP BY 1""")
def _(t):
    points = t.cells().select(F.col("id").alias("point_id"), "lon", "lat")
    return spatial.huc_for_points(points, t.hucs(), 4).select("point_id", "huc_id", "name")


@query("huc_drought_cells_of_a_day", f"""{MATCH_BUMPED_SQL}, c AS (SELECT event_id * 100 + h AS id, 41.0007e0 - 0.01e0 * (((event_id + h * 7) % 397) + 0.5e0) AS lat, -109.0003e0 + 0.01e0 * (((event_id + h * 11) % 691) + 0.5e0) AS lon, value
  FROM events, (SELECT unnest(range(60)) AS h) WHERE ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-07')
SELECT huc_id AS polygon_id, round(lat, 6) AS latitude, round(lon, 6) AS longitude, value FROM c, re GROUP BY huc_id, id, lat, lon, value
HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1""")
def _(t):
    e, h = F.col("event_id"), F.col("h")
    cells = t.events.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(59)))).select(
        ((e + h * 7) % 397).alias("row"), ((e + h * 11) % 691).alias("col"), "ts", "value")
    out = watershed.huc_drought_cells(_pts(t), bumped_hucs(t), cells, (0.01, 0, -109.0003, 0, -0.01, 41.0007), tolerance=TOLERANCE, on="2024-01-06")
    return out.withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})


# --- a layer landed as one document ----------------------------------------------------------------

@query("watershed_layer", f"""WITH {RINGS_SQL} SELECT lpad(CAST(k AS VARCHAR), 8, '0') AS huc_id, s_name AS name, i AS seq, round(x, 6) AS lon, round(y, 6) AS lat
FROM vertex JOIN supplier ON s_suppkey = k""")
def _(t):
    """The suppliers' rings, written as one GeoJSON file and read by features."""
    named = t.supplier.select(F.col("s_suppkey").alias("polygon_id"), F.col("s_name").alias("name"))
    ring = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lpad(F.col("polygon_id").cast("string"), 8, "0").alias("huc8"), "name").alias("properties"),
                       F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    rows = t.rings().join(named, "polygon_id").select("polygon_id", F.to_json(feature).alias("value"))
    first = rows.agg(F.min("polygon_id")).first()[0]
    lines = rows.select(F.col("polygon_id").alias("at"), F.concat(F.when(F.col("polygon_id") == first, '{"type":"FeatureCollection","features":[').otherwise(","), "value").alias("value"))
    end = t.spark.createDataFrame([(1 << 62, "]}")], "at long, value string")
    path = new_folder(t.spark, "layer")
    lines.unionByName(end).coalesce(1).sortWithinPartitions("at").select("value").write.option("lineSep", " ").text(path)
    out = ring_vertices(watershed_source.read_watershed_geojson(t.spark, path, 8).select("huc_id", "name", "ring"), "huc_id")
    names = t.hucs().select("huc_id", "name")
    return out.join(names, "huc_id").select("huc_id", "name", F.col("seq").cast("long").alias("seq"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
