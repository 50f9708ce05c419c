"""Readers: tables rendered to the landed text or JSON, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import day_sql, query
from freshet.functions.numeric import number_from_text
from freshet.operators import filters, snow
from freshet.sources import flow, grids, snow as snow_source, stations, watershed, weather
from freshet.plans.dataset import build_station_catalog

# --- gauges -----------------------------------------------------------------------

_RDB = """SELECT event_id, CAST(user_id AS VARCHAR) || strftime(ts, '-%d') AS station_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS ts, value AS flow, event_type FROM events"""


def _rdb_lines(t):
    e = F.col("event_type")
    stamp = F.when(e == "signup", "NotADate").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    shown = F.when(e == "error", "Ice").otherwise(F.col("value").cast("string"))
    site = F.concat(F.col("user_id").cast("string"), F.date_format("ts", "-dd"))
    line = F.concat_ws("\t", F.when(e == "view", "# USGS").otherwise("USGS"), site, stamp, F.lit("MST"), shown, F.lit("P"))
    return t.events.select(F.when(e == "purchase", F.array(line, F.lit("# note"), F.lit("agency_cd\tsite_no\tdatetime\ttz_cd\t1_00060"), F.lit("USGS\t1\t2024-01-01 00:00")))
                           .otherwise(F.array(line)).alias("a")).select(F.explode("a").alias("value"))


@query("flow_rdb", f"SELECT station_id, ts, flow FROM ({_RDB}) WHERE event_type IN ('click', 'purchase')")
def _(t):
    return flow.parse_flow_rdb(_rdb_lines(t))


@query("flow_rdb_strict", f"""SELECT station_id, ts, flow FROM ({_RDB}) WHERE event_type IN ('click', 'purchase')
AND station_id NOT IN (SELECT station_id FROM ({_RDB}) WHERE event_type = 'error')""")
def _(t):
    return flow.parse_flow_rdb(_rdb_lines(t), strict=True)


_JSON_SQL = """SELECT CAST(user_id AS VARCHAR) || strftime(ts, '-%d') AS station_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value AS flow, event_type FROM events"""


def _flow_docs(t):
    e = F.col("event_type")
    record = F.struct(
        F.concat(F.col("user_id").cast("string"), F.date_format("ts", "-dd")).alias("abbrev"), F.lit("DISCHRG").alias("parameter"),
        F.when(e == "signup", "This is not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("measDate"),
        F.when(e == "error", "Not a number").otherwise(F.col("value").cast("string")).alias("measValue"), F.lit("cfs").alias("measUnit"))
    text = F.when(e == "view", "{}").otherwise(F.to_json(F.struct(F.array(record).alias("ResultList"))))
    return t.events.select(F.from_json(text, flow.FLOW_JSON).alias("d")).select("d.*")


@query("flow_json", f"SELECT station_id, ts, flow FROM ({_JSON_SQL}) WHERE event_type IN ('click', 'purchase')")
def _(t):
    return flow.parse_flow_json(_flow_docs(t))


@query("flow_json_strict", f"""SELECT station_id, ts, flow FROM ({_JSON_SQL}) WHERE event_type IN ('click', 'purchase')
AND station_id NOT IN (SELECT station_id FROM ({_JSON_SQL}) WHERE event_type IN ('error', 'signup'))""")
def _(t):
    return flow.parse_flow_json(_flow_docs(t), strict=True)


@query("site_list", "SELECT 'USGS:' || s_suppkey AS value FROM supplier")
def _(t):
    key = F.concat(F.lit("  USGS:"), F.col("s_suppkey").cast("string"), F.lit(" "))
    return flow.parse_sites(t.supplier.select(F.explode(F.array(key, F.lit("   "))).alias("value")))


@query("site_inventory", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS site_id, 37 + s_acctbal / 1e3 AS lat, -109 + s_acctbal / 1e3 AS lon FROM supplier")
def _(t):
    row = F.concat_ws("\t", F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), "s_name",
                      (37 + F.col("s_acctbal") / 1000.0).cast("string"), (-109 + F.col("s_acctbal") / 1000.0).cast("string"))
    head = [F.lit(x) for x in ("# retrieved", "site_no\tstation_nm\tdec_lat_va\tdec_long_va", "15s\t50s\t16s\t16s", "")]
    return flow.parse_site_inventory(t.supplier.select(F.explode(F.array(*head, row)).alias("value")))


@query("agency_coordinates", "SELECT s_name AS site_id, 37 + s_acctbal / 1e3 AS lat, -109 + s_acctbal / 1e3 AS lon FROM supplier")
def _(t):
    row = F.concat_ws("\t", "s_name", (-109 + F.col("s_acctbal") / 1000.0).cast("string"), (37 + F.col("s_acctbal") / 1000.0).cast("string"))
    lines = t.supplier.select(F.explode(F.array(F.lit("abbrev\tlongitude\tlatitude"), row)).alias("value"))
    return flow.parse_agency_coordinates(lines, ("abbrev", "longitude", "latitude"))


# --- weather -------------------------------------------------------------------------

@query("wx_station_list", "SELECT 'US' || c_name AS wx_id, 37 + c_acctbal / 1e4 AS lat, -109 + c_acctbal / 1e4 AS lon FROM customer")
def _(t):
    line = F.concat(F.lit("US"), "c_name", F.lit("   "), (37 + F.col("c_acctbal") / 10000.0).cast("string"), F.lit(" "),
                    (-109 + F.col("c_acctbal") / 10000.0).cast("string"), F.lit("  1655.0 CO "), "c_mktsegment")
    return weather.parse_wx_stations(t.customer.select(line.alias("value")))


@query("wx_station_meta", f"""SELECT 'GHCND:US' || o_orderkey AS wx_id, o_totalprice / 5e5 AS datacoverage, {day_sql('o_orderdate')} AS mindate,
CASE WHEN o_orderstatus <> 'F' THEN '2024-02-29' END AS maxdate FROM orders""")
def _(t):
    head = F.when(F.col("o_orderstatus") == "O", "GHCND:US").otherwise("US")
    doc = F.to_json(F.struct(
        F.concat(head, F.col("o_orderkey").cast("string")).alias("id"), (F.col("o_totalprice") / 500000.0).alias("datacoverage"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("mindate"), F.when(F.col("o_orderstatus") == "F", "2023-02-29").otherwise("2024-02-29").alias("maxdate")))
    return weather.parse_wx_meta(t.orders.select(F.from_json(doc, weather.WX_META).alias("d")).select("d.*"))


@query("wx_station_fields", "SELECT CAST(p_partkey AS VARCHAR) AS wx_id, unnest(string_split(p_name, ' ')) AS datatype FROM part")
def _(t):
    buckets = F.transform(F.split("p_name", " "), lambda k: F.struct(k.alias("key"), F.lit(3).alias("docCount")))
    doc = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("station"), F.struct(buckets.alias("buckets")).alias("dataTypes")))
    return weather.parse_wx_fields(t.part.select(F.from_json(doc, weather.WX_FIELDS).alias("d")).select("d.*"))


@query("wx_daily", f"""SELECT CAST(user_id AS VARCHAR) AS noaa_station, {day_sql('ts')} AS date, CASE WHEN event_type NOT IN ('view', 'error') THEN value END AS tmin,
value + 10 AS tmax, event_id FROM events""")
def _(t):
    e = F.col("event_type")
    rows = t.events.select(
        F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"')).alias("STATION"),
        F.concat(F.lit(' "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"')).alias("DATE"),
        F.when(e == "view", "").when(e == "error", '"n/a"').otherwise(F.col("value").cast("string")).alias("TMIN"),
        F.concat(F.lit('" '), (F.col("value") + 10).cast("string"), F.lit('"')).alias("TMAX"), "event_id")
    parsed = weather.parse_wx_daily(rows.withColumn("STATION", F.concat("STATION", F.lit("|"), F.col("event_id").cast("string"))))
    return parsed.withColumns({"event_id": F.split("noaa_station", r"\|")[1].cast("long"), "noaa_station": F.split("noaa_station", r"\|")[0]})


# --- station catalogues -----------------------------------------------------------------

_DWR_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS abbreviation, c_mktsegment AS name, CAST(c_acctbal AS DOUBLE) AS latitude, CAST(-c_acctbal AS DOUBLE) AS longitude,
CAST(NULL AS VARCHAR) AS usgs_site_id, CAST(c_nationkey AS VARCHAR) AS county, 'CO' AS state, CAST(NULL AS VARCHAR) AS division, CAST(NULL AS VARCHAR) AS water_district, 'DWR' AS data_source,
CAST(NULL AS VARCHAR) AS start_date, CAST(NULL AS VARCHAR) AS end_date, 'cfs' AS measurement_unit, CAST(NULL AS DOUBLE) AS last_reading, CAST(NULL AS VARCHAR) AS last_reading_date FROM customer"""
_USGS_SQL = """SELECT CASE WHEN s_nationkey > 4 THEN CAST(s_suppkey AS VARCHAR) END AS id, CAST(NULL AS VARCHAR) AS abbreviation, s_name AS name, CAST(s_acctbal AS DOUBLE) AS latitude,
CAST(-s_acctbal AS DOUBLE) AS longitude, CASE WHEN s_nationkey > 4 THEN CAST(s_suppkey AS VARCHAR) END AS usgs_site_id, CASE WHEN s_nationkey > 9 THEN CAST(s_nationkey AS VARCHAR) END AS county,
'08' AS state, CAST(NULL AS VARCHAR) AS division, CAST(NULL AS VARCHAR) AS water_district, 'USGS' AS data_source, CAST(NULL AS VARCHAR) AS start_date, CAST(NULL AS VARCHAR) AS end_date,
'ft3/s' AS measurement_unit, CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal AS DOUBLE) END AS last_reading, CASE WHEN s_acctbal > 0 THEN '2024-05-01T00:00' END AS last_reading_date FROM supplier"""


def _dwr(t):
    doc = F.to_json(F.struct(F.array(F.struct(
        F.col("c_custkey").alias("stationNum"), F.col("c_name").alias("abbrev"), F.col("c_mktsegment").alias("stationName"), F.col("c_acctbal").alias("latitude"),
        (-F.col("c_acctbal")).alias("longitude"), F.col("c_nationkey").cast("string").alias("county"), F.lit("CO").alias("state"), F.lit("DWR").alias("dataSource"),
        F.lit("cfs").alias("measUnit"), F.lit(1).alias("unused"))).alias("ResultList")))
    return stations.parse_stations_dwr(t.customer.select(F.from_json(doc, stations.DWR_JSON).alias("d")).select("d.*"))


def _usgs(t):
    n = F.col("s_nationkey")

    def named(name, value):
        return F.struct(value.alias("value"), F.lit(name).alias("name"))

    code = F.struct(F.col("s_suppkey").cast("string").alias("value"), F.when(n > 4, "USGS").otherwise("COE").alias("agencyCode"))
    props = F.array(named("stateCd", F.lit("08")), named("hucCd", F.lit("14")))
    props = F.when(n > 9, F.concat(props, F.array(named("countyCd", n.cast("string"))))).otherwise(props)
    reading = F.struct(F.col("s_acctbal").cast("string").alias("value"), F.lit("2024-05-01T00:00").alias("dateTime"))
    readings = F.when(F.col("s_acctbal") > 0, F.array(reading, reading)).otherwise(F.filter(F.array(reading), lambda _: F.lit(False)))
    place = F.struct(F.struct(F.col("s_acctbal").alias("latitude"), (-F.col("s_acctbal")).alias("longitude")).alias("geogLocation"))
    info = F.struct(F.col("s_name").alias("siteName"), F.array(code).alias("siteCode"), place.alias("geoLocation"), props.alias("siteProperty"))
    series = F.struct(info.alias("sourceInfo"), F.struct(F.struct(F.lit("ft3/s").alias("unitCode")).alias("unit")).alias("variable"),
                      F.array(F.struct(readings.alias("value"))).alias("values"))
    doc = F.to_json(F.struct(F.struct(F.array(series).alias("timeSeries")).alias("value")))
    return stations.parse_stations_usgs(t.supplier.select(F.from_json(doc, stations.USGS_JSON).alias("d")).select("d.*"))


@query("stations_dwr", _DWR_SQL)
def _(t):
    return _dwr(t)


@query("stations_usgs", _USGS_SQL)
def _(t):
    return _usgs(t)


@query("station_catalog", f"{_DWR_SQL} UNION ALL {_USGS_SQL}")
def _(t):
    return build_station_catalog(_dwr(t), _usgs(t))


# --- snow -----------------------------------------------------------------------------------

_SWE_SQL = f"""WITH d AS (SELECT CAST(o_custkey AS VARCHAR) AS basin, strftime(o_orderdate, '%m-%d') AS month_day, CAST(year(o_orderdate) AS VARCHAR) AS y, max(o_totalprice) AS swe FROM orders GROUP BY 1, 2, 3)"""


def _swe_docs(t):
    """A snow document per customer: a record per day of the year, one entry per year."""
    d = t.orders.groupBy(F.col("o_custkey").cast("string").alias("basin"), F.date_format("o_orderdate", "MM-dd").alias("md"),
                         F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.max("o_totalprice").cast("string").alias("v"))
    entry = F.map_concat(F.create_map(F.lit("date"), F.col("md"), F.lit("Median"), F.lit("1")), F.map_from_entries("e"))
    records = d.groupBy("basin", "md").agg(F.collect_list(F.struct("y", "v")).alias("e")).select("basin", entry.alias("m"))
    return records.select("basin", F.to_json(F.array("m")).alias("value"))


@query("swe_wide", f"{_SWE_SQL} SELECT basin, month_day, count(*) + 1 AS n, max(y) AS newest, sum(swe) AS total FROM d GROUP BY 1, 2")
def _(t):
    years = F.map_filter("years", lambda k, _: k != "Median")
    return snow_source.parse_swe_wide(_swe_docs(t)).select(
        "basin", "month_day", F.size("years").cast("long").alias("n"), F.array_max(F.map_keys(years)).alias("newest"),
        F.aggregate(F.map_values(years), F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("swe_to_daily", f"{_SWE_SQL} SELECT basin, y || '-' || month_day AS date, swe FROM d WHERE y || '-' || month_day BETWEEN '1996-02-15' AND '2000-03-10'")
def _(t):
    return snow.swe_to_daily(snow_source.parse_swe_wide(_swe_docs(t)), "1996-02-15", "2000-03-10")


# Every customer's orders again, but under every year: only real days may come out.
@query("swe_leap_days", f"""WITH md AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS basin, strftime(o_orderdate, '%m-%d') AS md FROM orders)
SELECT basin, y || '-' || md AS date, CAST(y AS DOUBLE) AS swe FROM md, (SELECT CAST(range AS VARCHAR) AS y FROM range(1995, 2005)) WHERE try_cast(y || '-' || md AS DATE) IS NOT NULL""")
def _(t):
    md = t.orders.select(F.col("o_custkey").cast("string").alias("basin"), F.date_format("o_orderdate", "MM-dd").alias("month_day")).distinct()
    years = F.map_from_entries(F.transform(F.sequence(F.lit(1990), F.lit(2010)), lambda y: F.struct(y.cast("string"), y.cast("double"))))
    return snow.swe_to_daily(md.withColumn("years", years), "1995-01-01", "2004-12-31")


@query("year_values", f"{_SWE_SQL} SELECT basin, month_day, count(*) FILTER (WHERE y BETWEEN '1997' AND '1999') AS n FROM d GROUP BY 1, 2")
def _(t):
    kept = snow.year_values(snow_source.parse_swe_wide(_swe_docs(t)), 1997, 1999)
    return kept.select("basin", "month_day", F.size("years").cast("long").alias("n"))


_BASINS_SQL = "basins(basin_type, basin, source) AS (VALUES " + ", ".join(
    "('{}', '{}', '{}/{}')".format(kind, b, snow_source.FOLDERS[kind], snow_source.source_file(b))
    for kind, names in (("basin", snow_source.BASINS), ("subbasin", snow_source.SUBBASINS)) for b in names) + ")"


def _basin_requests(t):
    names = F.array(*[F.lit(b.title()) for b in snow_source.BASINS + snow_source.SUBBASINS], F.lit("nowhere"), F.lit(""))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Basin").when(F.col("c_mktsegment") == "MACHINERY", "river").otherwise("subbasin")
    return t.customer.select("c_custkey", kind.alias("basin_type"),
                             F.get(names, (F.col("c_custkey") % 55).cast("int")).alias("basin_name"))


@query("resolve_basin", f"""WITH {_BASINS_SQL}, n AS (SELECT *, row_number() OVER () - 1 AS i FROM basins),
r AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'basin' WHEN 'MACHINERY' THEN 'river' ELSE 'subbasin' END AS basin_type, n.basin FROM customer JOIN n ON i = c_custkey % 55)
SELECT c_custkey, basins.basin, source FROM r JOIN basins USING (basin_type, basin)""")
def _(t):
    return filters.resolve_basin(_basin_requests(t), snow_source.basin_dim(t.spark)).select("c_custkey", "basin", "source")


@query("snow_daily", f"SELECT CAST(user_id AS VARCHAR) AS triplet, {day_sql('ts')} AS date, CASE WHEN event_type <> 'error' THEN value END AS swe FROM events")
def _(t):
    return snow_source.parse_snow_daily(_snow_docs(t))


def _snow_docs(t):
    v = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("event_type") != "error", F.col("value").cast("string")).alias("value"))
    doc = F.to_json(F.struct(F.col("user_id").cast("string").alias("stationTriplet"), F.array(F.struct(F.array(v).alias("values"))).alias("data")))
    return t.events.select(F.from_json(doc, snow_source.SNOW_DAILY_JSON).alias("d")).select("d.*")


@query("snow_for_huc", f"""SELECT CAST(user_id AS VARCHAR) AS triplet, {day_sql('ts')} AS date, value AS swe FROM events
WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey BETWEEN 10 AND 14) AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def _(t):
    huc = F.when(F.col("s_nationkey").between(10, 14), "14080104").otherwise("13010001")
    gauges = t.supplier.select(F.col("s_suppkey").cast("string").alias("triplet"), huc.alias("huc"))
    daily = t.events.select(F.col("user_id").cast("string").alias("triplet"), F.to_date("ts").alias("date"), F.col("value").alias("swe"))
    return snow.snow_for_huc(gauges, daily, "1408", "2024-01-10", "2024-01-20")


@query("snow_report", f"SELECT {day_sql('ts')} AS date, value AS swe FROM events WHERE event_type IN ('click', 'purchase')")
def _(t):
    e, v = F.col("event_type"), F.col("value").cast("string")
    d = F.date_format("ts", "yyyy-MM-dd")
    line = (F.when(e == "view", F.concat(F.lit("# "), d, F.lit(","), v)).when(e == "error", F.concat(d, F.lit(","))).when(e == "signup", d)
            .otherwise(F.concat(d, F.lit(","), v)))
    return snow_source.parse_snow_report(t.events.select(line.alias("value")))


# --- watersheds, grids, catalogues -----------------------------------------------------------

_SQUARE = ((0, 0), (1, 0), (1, 1), (0, 1))
_VERTEX_SQL = "(VALUES " + ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(_SQUARE)) + ") v(seq, x, y)"


def _ring_json():
    return F.array(*[F.array((F.col("s_suppkey") + x).cast("double"), (F.col("s_nationkey") + y).cast("double")) for x, y in _SQUARE])


def _attributes():
    return F.struct(F.lit("14").alias("huc2"), F.concat(F.lit("08"), F.col("s_suppkey").cast("string")).alias("huc8"), F.col("s_name").alias("name"))


_SQUARES_SQL = f"SELECT 8 AS huc_level, '08' || s_suppkey AS huc_id, s_name AS name, seq, CAST(s_suppkey + x AS DOUBLE) AS lon, CAST(s_nationkey + y AS DOUBLE) AS lat FROM supplier, {_VERTEX_SQL}"


def _vertices(polygons):
    return polygons.select("huc_level", "huc_id", "name", F.posexplode("ring").alias("seq", "p")).select(
        "huc_level", "huc_id", "name", "seq", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


@query("huc_polygons", _SQUARES_SQL)
def _(t):
    feature = F.struct(F.struct(F.array(_ring_json(), _ring_json()).alias("rings")).alias("geometry"), _attributes().alias("attributes"))
    doc = F.to_json(F.struct(F.array(feature, feature).alias("features")))
    docs = t.supplier.select(F.from_json(doc, watershed.HUC_JSON).alias("d")).select("d.*")
    return _vertices(watershed.parse_huc_polygons(docs, 8, first_only=True))


@query("watershed_geojson", _SQUARES_SQL)
def _(t):
    feature = F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(_ring_json()).alias("coordinates")).alias("geometry"), _attributes().alias("properties"))
    doc = F.to_json(F.struct(F.array(feature).alias("features")))
    docs = t.supplier.select(F.from_json(doc, watershed.GEOJSON).alias("d")).select("d.*")
    return _vertices(watershed.parse_watershed_geojson(docs, 8))


@query("grid_cells", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS lat,
CASE WHEN l_quantity = l_linenumber THEN NULL WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS value FROM lineitem""")
def _(t):
    fill = F.lit(-9999.0)
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", fill).otherwise(F.col("l_extendedprice")).alias("lat"),
        F.when(F.col("l_returnflag") == "A", float("nan")).otherwise(F.col("l_quantity")).alias("value"), F.col("l_linenumber").cast("double").alias("nodata"))
    return grids.parse_grid_cells(rows)


@query("product_layers", """SELECT p_brand || p_partkey AS product, CAST(i AS INTEGER) AS ordinal, CASE i WHEN 0 THEN 'z_' || p_type ELSE 'a_' || p_size END AS layer,
CASE i WHEN 0 THEN p_name END AS description FROM part, range(2) t(i)""")
def _(t):
    doc = F.concat(F.lit('{"z_'), "p_type", F.lit('": {"Description": "'), "p_name", F.lit('"}, "a_'), F.col("p_size").cast("string"), F.lit('": {}}'))
    docs = t.part.select(F.concat("p_brand", F.col("p_partkey").cast("string")).alias("product"), doc.alias("value"))
    return grids.parse_product_layers(docs)


@query("number_from_text", "SELECT page_id, try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS DOUBLE) AS n FROM pages")
def _(t):
    return t.pages.select("page_id", number_from_text(F.regexp_extract("url", "([0-9]+)", 1)).alias("n"))
