"""Daily values, merging, filling, smoothing, scaling, windows, filters, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import day_sql, query
from freshet.functions import dates, nested, numeric, text
from freshet.operators import filters, flows, nearest, scaling, series

# --- daily values and merging ------------------------------------------------

DAILY = f"""SELECT CAST(user_id AS VARCHAR) AS station_id, {day_sql('ts')} AS date, min(value) AS min_flow, max(value) AS max_flow
FROM events GROUP BY 1, 2"""


@query("daily_extremes", DAILY)
def _(t):
    return flows.daily_extremes(t.readings())


@query("daily_extremes_with_season", f"""SELECT *, round((dayofyear(CAST(date AS DATE)) - 1) /
(365 + CASE WHEN dayofyear(make_date(year(CAST(date AS DATE)), 12, 31)) = 366 THEN 1 ELSE 0 END), 6) AS season FROM ({DAILY})""")
def _(t):
    return flows.daily_extremes(t.readings()).withColumn("season", F.round(dates.year_fraction(F.col("date")), 6))


@query("select_readings", """SELECT event_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'""")
def _(t):
    return flows.select_readings(t.events, filters.day("2024-01-05"), filters.day("2024-01-20"), ["event_id", "value", "ts"],
                                 "purchase", parameter_col="event_type")


SIDES = f"""WITH wx AS (SELECT CAST(user_id AS VARCHAR) AS station_id, {day_sql('ts')} AS date, min(value) AS tmin, max(value) AS tmax
  FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
fl AS (SELECT CAST(user_id AS VARCHAR) AS station_id, {day_sql('ts')} AS date, min(value) AS min_flow, max(value) AS max_flow
  FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)"""


def _sides(t):
    keyed = t.events.select(F.col("user_id").cast("string").alias("station_id"), "ts", F.col("value").alias("flow"), "event_id")
    wx, fl = keyed.where(F.col("event_id") % 2 == 0), keyed.where(F.col("event_id") % 2 == 1)
    return (flows.daily_extremes(wx).withColumnsRenamed({"min_flow": "tmin", "max_flow": "tmax"}), flows.daily_extremes(fl))


@query("merge_weather_flow", f"{SIDES} SELECT date, station_id, tmin, tmax, min_flow, max_flow FROM wx FULL JOIN fl USING (date, station_id)")
def _(t):
    return flows.merge_weather_flow(*_sides(t), fill=False)


@query("merge_weather_flow_filled", SIDES + " SELECT date, station_id, " + ", ".join(
    f"round(coalesce({c}, avg({c}) OVER (PARTITION BY station_id)), 6) AS {c}" for c in ("tmin", "tmax", "min_flow", "max_flow"))
    + " FROM wx FULL JOIN fl USING (date, station_id)")
def _(t):
    merged = flows.merge_weather_flow(*_sides(t))
    return merged.withColumns({c: F.round(c, 6) for c in flows.VALUE_COLUMNS})


TWO_SETS = """WITH a AS (SELECT o_custkey AS station_id, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_custkey AS station_id, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 1)"""


def _two_sets(t, *extra):
    o = t.orders.select(F.col("o_custkey").alias("station_id"), F.col("o_orderkey").alias("id"), *extra)
    return tuple(o.where(F.col("id") % 2 == side) for side in (0, 1))


@query("sites_with_both", f"""{TWO_SETS} SELECT 'a' AS side, * FROM a WHERE station_id IN (SELECT station_id FROM b)
UNION ALL SELECT 'b', * FROM b WHERE station_id IN (SELECT station_id FROM a)""")
def _(t):
    a, b = flows.sites_with_both(*_two_sets(t))
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


@query("one_sided_sites", f"""{TWO_SETS} SELECT DISTINCT station_id, 'no flow' AS reason FROM a WHERE station_id NOT IN (SELECT station_id FROM b)
UNION ALL SELECT DISTINCT station_id, 'no weather' FROM b WHERE station_id NOT IN (SELECT station_id FROM a)""")
def _(t):
    return flows.one_sided_sites(*_two_sets(t))


@query("drop_bad_date_sites", f"""WITH s AS (SELECT o_custkey AS station_id, o_orderkey AS id,
  CASE WHEN o_totalprice > 470000 THEN 'no date' ELSE {day_sql('o_orderdate')} END AS date FROM orders),
bad AS (SELECT station_id FROM s WHERE date = 'no date')
SELECT station_id, id, date FROM s WHERE station_id NOT IN (SELECT station_id FROM bad)""")
def _(t):
    d = F.when(F.col("o_totalprice") > 470000, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date")
    a, b = flows.drop_bad_date_sites(*_two_sets(t, d))
    return a.unionByName(b)


@query("union_sites", """SELECT event_id, value, NULL AS props FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, NULL, props FROM events WHERE event_id % 2 = 1""")
def _(t):
    e = t.events
    return flows.union_sites([e.where(F.col("event_id") % 2 == 0).select("event_id", "value"),
                              e.where(F.col("event_id") % 2 == 1).select("event_id", "props")])


# --- whole-column statistics --------------------------------------------------

@query("fill_mean", """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 10 THEN p_retailprice END AS price FROM part)
SELECT p_partkey, round(coalesce(price, avg(price) OVER ()), 6) AS price FROM p""")
def _(t):
    p = t.part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"))
    return scaling.fill_mean(p, ["price"]).withColumn("price", F.round("price", 6))


@query("fill_mean_by_group", """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 10 THEN p_retailprice END AS price FROM part)
SELECT p_partkey, p_brand, round(coalesce(price, avg(price) OVER (PARTITION BY p_brand)), 6) AS price FROM p""")
def _(t):
    p = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"))
    return scaling.fill_mean(p, ["price"], by="p_brand").withColumn("price", F.round("price", 6))


@query("standardize", """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
  / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS price, CAST(0 AS DOUBLE) AS flat FROM orders""")
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(7.0).alias("flat"))
    return scaling.standardize(o, ["price", "flat"]).withColumn("price", F.round("price", 6))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("one_hot", "SELECT o_orderkey, " + ", ".join(
    f"coalesce(o_orderpriority = '{p}', false) AS \"station_{p}\"" for p in PRIORITIES) + " FROM orders")
def _(t):
    hot = scaling.one_hot(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "station", PRIORITIES)
    return hot.select("o_orderkey", *[F.col(f"`{c}`") for c in filters.prefixed_columns(hot)])


@query("one_hot_index", """SELECT count(DISTINCT o_custkey) AS n_values, 0 AS lowest, count(DISTINCT o_custkey) - 1 AS highest,
count(DISTINCT o_custkey) AS n_indexes, count(*) AS n_rows FROM orders""")
def _(t):
    i = scaling.one_hot_index(t.orders.select("o_custkey"), "o_custkey", "i").groupBy("o_custkey", "i").count()
    return i.agg(F.countDistinct("o_custkey").alias("n_values"), F.min("i").cast("int").alias("lowest"), F.max("i").alias("highest"),
                 F.countDistinct("i").alias("n_indexes"), F.sum("count").alias("n_rows"))


@query("distinct_values", "SELECT DISTINCT user_id FROM events")
def _(t):
    return scaling.distinct_values(t.events, "user_id")


# --- series -------------------------------------------------------------------

GAPPY = f"""g AS (SELECT station_id, date, CASE WHEN lo >= 4 THEN lo END AS tmin, CASE WHEN hi <= 60 THEN hi END AS tmax FROM (
  SELECT CAST(user_id AS VARCHAR) AS station_id, {day_sql('ts')} AS date, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2))"""
_W = "PARTITION BY station_id ORDER BY date"


def _sql_each(expr: str, source: str = "g") -> str:
    return "SELECT station_id, date, " + ", ".join(f"{expr.format(c=c)} AS {c}" for c in ("tmin", "tmax")) + f" FROM {source}"


_ROLL = f"avg({{c}}) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_BACK = f"coalesce({{c}}, first_value({{c}} IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
_FORTH = f"coalesce({{c}}, last_value({{c}} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("tmin", "tmax")})


@query("centered_rolling_mean", f"WITH {GAPPY} " + _sql_each(f"round({_ROLL}, 6)"))
def _(t):
    return _rounded(series.centered_rolling_mean(t.gappy_daily(), ["tmin", "tmax"], "station_id", "date"))


@query("centered_rolling_mean_long", f"WITH {GAPPY} " + _sql_each(f"round(avg({{c}}) OVER ({_W} ROWS BETWEEN 4500 PRECEDING AND 4500 FOLLOWING), 6)"))
def _(t):
    """Frames wider than the pieces that a series is cut into."""
    return _rounded(series.centered_rolling_mean(t.gappy_daily(), ["tmin", "tmax"], "station_id", "date", window=9001))


@query("centered_rolling_mean_of_missing", f"WITH {GAPPY} " + _sql_each(f"round(coalesce({{c}}, {_ROLL}), 6)"))
def _(t):
    return _rounded(series.centered_rolling_mean(t.gappy_daily(), ["tmin", "tmax"], "station_id", "date", only_missing=True))


@query("backward_fill", f"WITH {GAPPY} " + _sql_each(_BACK))
def _(t):
    return series.backward_fill(t.gappy_daily(), ["tmin", "tmax"], "station_id", "date")


@query("forward_fill", f"WITH {GAPPY} " + _sql_each(_FORTH))
def _(t):
    return series.forward_fill(t.gappy_daily(), ["tmin", "tmax"], "station_id", "date")


@query("smooth_temperatures", f"WITH {GAPPY}, r AS ({_sql_each(_ROLL)}), b AS ({_sql_each(_BACK, 'r')}), f AS ({_sql_each(_FORTH, 'b')}) "
       + _sql_each("round({c}, 6)", "f"))
def _(t):
    return _rounded(series.smooth_temperatures(t.gappy_daily()))


@query("number_rows", f"WITH {GAPPY} SELECT station_id, date, row_number() OVER ({_W}) - 1 AS n FROM g")
def _(t):
    return series.number_rows(t.gappy_daily(), "station_id", "date", out="n").select("station_id", "date", "n")


@query("densify_days", f"""WITH {GAPPY}, d AS (SELECT station_id, unnest(generate_series(min(CAST(date AS DATE)), max(CAST(date AS DATE)), INTERVAL 1 DAY)) AS day
  FROM g GROUP BY 1), e AS (SELECT station_id, {day_sql('day')} AS date FROM d)
SELECT station_id, date, tmin, tmax FROM e LEFT JOIN g USING (station_id, date)""")
def _(t):
    return series.densify(t.gappy_daily())


_WIN = f"""WITH d AS ({DAILY}),
w AS (SELECT station_id, date AS start, lead(date, 7) OVER w AS "end",
  sum(min_flow) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS x_min, sum(max_flow) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS x_max,
  lead(min_flow, 6) OVER w AS y_first, lead(max_flow, 7) OVER w AS y_last FROM d WINDOW w AS ({_W}))"""


def _windows(t):
    return series.sliding_windows(flows.daily_extremes(t.readings()), history=4, forecast=2, horizon=2,
                                  features=["min_flow", "max_flow"], targets=["min_flow", "max_flow"])


@query("sliding_windows", _WIN + """ SELECT station_id, start, "end", round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, y_first, y_last
FROM w WHERE "end" IS NOT NULL""")
def _(t):
    def total(i):
        return F.round(F.aggregate("x", F.lit(0.0), lambda s, r: s + F.get(r, F.lit(i))), 6)
    return _windows(t).select("station_id", "start", "end", total(0).alias("x_min"), total(1).alias("x_max"),
                              F.expr("y[0][0]").alias("y_first"), F.expr("y[1][1]").alias("y_last"))


@query("split_windows_by_time", _WIN + """ SELECT station_id, start, CASE WHEN "end" < '2024-01-20' THEN 'train' ELSE 'test' END AS part
FROM w WHERE "end" IS NOT NULL AND ("end" < '2024-01-20' OR start >= '2024-01-20')""")
def _(t):
    train, test = series.split_windows_by_time(_windows(t), filters.day("2024-01-20"))
    return (train.select("station_id", "start", F.lit("train").alias("part"))
            .unionByName(test.select("station_id", "start", F.lit("test").alias("part"))))


@query("split_windows")
def _(t):
    train, test = series.split_windows(_windows(t), .2, seed=3)
    return (train.select("station_id", "start", F.lit("train").alias("part"))
            .unionByName(test.select("station_id", "start", F.lit("test").alias("part"))))


@query("split_windows_share", _WIN + """ SELECT count(*) AS n_windows, 0 AS n_in_both, true AS share_fits FROM w WHERE "end" IS NOT NULL""")
def _(t):
    """Every window on one side, about a fifth of them held out."""
    train, test = series.split_windows(_windows(t), .2, seed=3)
    key = ["station_id", "start"]
    sides = train.select(*key, F.lit(0).alias("held")).unionByName(test.select(*key, F.lit(1).alias("held")))
    per = sides.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("held").alias("held"))
    spread = 6 * F.sqrt(F.lit(.16) / F.count(F.lit(1)))  # six standard deviations of the share
    return per.agg(F.sum("n").alias("n_windows"), F.count_if(F.col("n") > 1).cast("int").alias("n_in_both"),
                   (F.abs(F.avg("held") - .2) <= spread).alias("share_fits"))


# --- filters, checks, lookups ---------------------------------------------------

@query("parse_site_keys", """WITH k AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'USGS:' WHEN 'click' THEN 'DWR:' WHEN 'error' THEN 'NOAA:'
  WHEN 'purchase' THEN '' ELSE 'USGS:x:' END || event_id AS station_id FROM events)
SELECT station_id, split_part(station_id, ':', 1) AS prefix,
  CASE WHEN regexp_matches(station_id, '^(USGS|DWR):[0-9]+$') THEN split_part(station_id, ':', 2) END AS site_id FROM k""")
def _(t):
    key = F.when(F.col("event_type") == "view", "USGS:").when(F.col("event_type") == "click", "DWR:").when(
        F.col("event_type") == "error", "NOAA:").when(F.col("event_type") == "purchase", "").otherwise("USGS:x:")
    known, rejected = filters.parse_site_keys(t.events.select(F.concat(key, F.col("event_id").cast("string")).alias("value")))
    return flows.union_sites([known, rejected])


WX = """wx AS (SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'CAN' ELSE 'USW' END || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS wx_id,
37 + (c_custkey % 400) / 1e2 AS lat, -109 + (c_custkey % 700) / 1e2 AS lon FROM customer)"""
META = """meta AS (SELECT 'USW' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS wx_id, max(o_totalprice) / 500000e0 AS datacoverage,
  min(CAST(o_orderdate AS DATE)) AS mindate, max(CAST(o_orderdate AS DATE)) AS maxdate FROM orders GROUP BY 1)"""
FIT = """fit AS (SELECT * FROM meta WHERE datacoverage > 0.87 AND (maxdate >= DATE '2000-06-01' OR maxdate >= DATE '1999-12-29')
  AND mindate <= DATE '2000-01-01')"""
FIELDS = """complete AS (SELECT 'USW' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS wx_id FROM orders GROUP BY 1
  HAVING count(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus IN ('F', 'O')) = 2)"""


@query("by_country", f"WITH {WX} SELECT * FROM wx WHERE wx_id LIKE 'US%'")
def _(t):
    return filters.by_country(t.wx_stations())


@query("filter_wx_stations", """WITH wx AS (SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'CAN00' WHEN 'BUILDING' THEN 'USX-' WHEN 'HOUSEHOLD' THEN 'USabc' ELSE 'USW0000' END
  || CAST(c_custkey AS VARCHAR) AS wx_id FROM customer) SELECT wx_id FROM wx WHERE regexp_matches(wx_id, '^US[a-zA-Z0-9_]{6}[0-9]+')""")
def _(t):
    head = F.when(F.col("c_mktsegment") == "MACHINERY", "CAN00").when(F.col("c_mktsegment") == "BUILDING", "USX-").when(
        F.col("c_mktsegment") == "HOUSEHOLD", "USabc").otherwise("USW0000")
    return filters.filter_wx_stations(t.customer.select(F.concat(head, F.col("c_custkey").cast("string")).alias("wx_id")))


@query("fit_stations", f"WITH {META}, {FIT} SELECT 'GHCND:' || wx_id AS wx_id, round(datacoverage, 6) AS datacoverage, {day_sql('mindate')} AS mindate, {day_sql('maxdate')} AS maxdate FROM fit")
def _(t):
    return filters.fit_stations(t.wx_meta(), "2000-01-01", "2000-06-01").withColumn("datacoverage", F.round("datacoverage", 6))


@query("has_all_fields", f"WITH {FIELDS} SELECT wx_id FROM complete")
def _(t):
    return filters.has_all_fields(t.wx_fields())


@query("has_all_fields_by_day", f"""SELECT user_id, {day_sql('ts')} AS date FROM events GROUP BY 1, 2
HAVING count(DISTINCT event_type) FILTER (WHERE event_type IN ('signup', 'error')) = 2""")
def _(t):
    return filters.has_all_fields(t.events.withColumn("date", F.to_date("ts")), ["signup", "error"], ["user_id", "date"], "event_type")


KM = """2 * 6371 * atan2(sqrt(h), sqrt(1 - h))"""
NEAR = f"""site AS (SELECT CAST(s_suppkey AS VARCHAR) AS site_id, 37 + (s_suppkey % 400) / 1e2 AS slat, -109 + (s_suppkey % 700) / 1e2 AS slon FROM supplier),
{WX}, h AS (SELECT site_id, wx_id, least(1, greatest(0, pow(sin((radians(lat) - radians(slat)) / 2), 2)
  + cos(radians(slat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(slon)) / 2), 2))) AS h FROM site, wx WHERE wx_id LIKE 'US%'),
near AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY km, wx_id) AS rank FROM (SELECT site_id, wx_id, round({KM}, 6) AS km FROM h) QUALIFY rank <= 50)"""


@query("nearest_stations", f"WITH {NEAR} SELECT * FROM near")
def _(t):
    out = nearest.nearest_stations(t.sites(), filters.filter_wx_stations(t.wx_stations()))
    return out.select("site_id", "wx_id", F.round("km", 6).alias("km"), F.col("rank").cast("long").alias("rank"))


@query("nearest_fit_station", f"""WITH {NEAR}, {META}, {FIT}, {FIELDS}
SELECT site_id, wx_id AS noaa_station, km, rank FROM near WHERE wx_id IN (SELECT wx_id FROM fit) AND wx_id IN (SELECT wx_id FROM complete)
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY rank) = 1""")
def _(t):
    out = nearest.nearest_fit_station(t.sites(), t.wx_stations(), t.wx_meta(), t.wx_fields(), "2000-01-01", "2000-06-01")
    return out.select("site_id", "noaa_station", F.round("km", 6).alias("km"), F.col("rank").cast("long").alias("rank"))


@query("lookup_sites", """SELECT o.o_orderkey, CAST(o.o_orderkey AS VARCHAR) AS site_id, 37 + (c_custkey % 400) / 1e2 AS lat, -109 + (c_custkey % 700) / 1e2 AS lon
FROM orders o LEFT JOIN customer ON c_custkey = o_orderkey""")
def _(t):
    inventory = t.wx_stations().select(F.ltrim(F.substring("wx_id", 4, 12), F.lit("0")).alias("site_id"), "lat", "lon")
    inventory = inventory.withColumn("site_id", F.when(F.col("site_id") == "", "0").otherwise(F.col("site_id")))
    return filters.lookup_sites(t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("site_id")), inventory).select(
        "o_orderkey", "site_id", "lat", "lon")


@query("lookup_sites_repeated", """WITH inv AS (SELECT c_custkey AS k, 37 + (c_custkey % 400) / 1e2 AS lat, -109 + (c_custkey % 700) / 1e2 AS lon FROM customer)
SELECT o.o_orderkey, CAST(o.o_custkey AS VARCHAR) AS site_id, lat, lon FROM orders o LEFT JOIN inv ON k = o_custkey""")
def _(t):
    """The inventory holds every line three times, one of them with other coordinates that sort later."""
    inventory = t.wx_stations().select(F.ltrim(F.substring("wx_id", 4, 12), F.lit("0")).alias("site_id"), "lat", "lon")
    inventory = inventory.withColumn("site_id", F.when(F.col("site_id") == "", "0").otherwise(F.col("site_id")))
    later = inventory.withColumn("lat", F.col("lat") + 10)
    return filters.lookup_sites(t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("site_id")),
                                later.union(inventory).union(inventory)).select("o_orderkey", "site_id", "lat", "lon")


@query("date_range", f"SELECT o_orderkey, {day_sql('o_orderdate')} AS date FROM orders WHERE o_orderdate BETWEEN DATE '1996-03-01' AND DATE '1999-02-28'")
def _(t):
    return filters.date_range(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date")), "1996-03-01", "1999-02-28")


@query("find_products", "SELECT doc_id, lang FROM documents WHERE contains(lower(coalesce(text, '')), 'the ')")
def _(t):
    return filters.find_products(t.documents, "The ", "text").select("doc_id", "lang")


@query("pick_layer", """SELECT p_brand AS product, arg_min(p_name, p_partkey) AS layer, arg_min(p_type, p_partkey) AS description, min(p_partkey) AS ordinal
FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') GROUP BY 1""")
def _(t):
    return filters.pick_layer(t.part.select(F.col("p_brand").alias("product"), F.col("p_name").alias("layer"),
                                            F.col("p_type").alias("description"), F.col("p_partkey").alias("ordinal")), "RING")


@query("latest_scene", f"""SELECT o_custkey AS dataset, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS scene_id, {day_sql('max(o_orderdate)')} AS acquisition_date
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1999-12-02' AND DATE '2000-01-01' GROUP BY 1""")
def _(t):
    return filters.latest_scene(t.orders.select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("scene_id"),
                                                F.to_date("o_orderdate").alias("acquisition_date")), "2000-01-01")


@query("smallest_granule", """SELECT o_custkey AS request_id, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS granule_id, min(o_totalprice) AS size_mb FROM orders GROUP BY 1""")
def _(t):
    return filters.smallest_granule(t.orders.select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("granule_id"),
                                                    F.col("o_totalprice").alias("size_mb")))


@query("valid_cells", "SELECT l_orderkey, l_linenumber, l_quantity AS value FROM lineitem WHERE l_quantity <> 50")
def _(t):
    return filters.valid_cells(filters.fill_to_null(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value")), ["value"], 50.0))


@query("in_bbox", "SELECT o_orderkey, o_orderkey % 397 AS lat FROM orders WHERE o_orderkey % 691 BETWEEN 90 AND 310 AND o_orderkey % 397 BETWEEN 40 AND 160")
def _(t):
    o = t.orders.select("o_orderkey", (F.col("o_orderkey") % 397).alias("lat"), (F.col("o_orderkey") % 691).alias("lon"))
    return o.where(numeric.in_bbox(F.col("lon"), F.col("lat"), (100, 50, 300, 150), 10)).drop("lon")


@query("preview", """(SELECT o_orderkey, 'head' AS part FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 4) UNION ALL
(SELECT o_orderkey, 'tail' FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 4)""")
def _(t):
    return filters.preview(t.orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "part")


@query("row_counts", "SELECT 'gauges' AS part, count(*) AS n FROM supplier UNION ALL SELECT 'readings', count(*) FROM events")
def _(t):
    return filters.row_counts({"gauges": t.supplier, "readings": t.events})


# --- scalars --------------------------------------------------------------------

_MESSY = """CASE event_type WHEN 'view' THEN ' ' || CAST(event_id AS VARCHAR) || '.5 ' WHEN 'click' THEN '' WHEN 'error' THEN 'n/a' WHEN 'purchase' THEN CAST(event_id AS VARCHAR) || 'd'
  ELSE '-' || CAST(event_id AS VARCHAR) || 'e1' END"""


def _messy():
    e, i = F.col("event_type"), F.col("event_id").cast("string")
    return (F.when(e == "view", F.concat(F.lit(" "), i, F.lit(".5 "))).when(e == "click", "").when(e == "error", "n/a")
            .when(e == "purchase", F.concat(i, F.lit("d"))).otherwise(F.concat(F.lit("-"), i, F.lit("e1"))))


@query("coerce_numeric", """SELECT event_id, CASE event_type WHEN 'view' THEN event_id + 0.5e0 WHEN 'signup' THEN -event_id * 10e0 END AS v FROM events""")
def _(t):
    e = t.events.select("event_id", _messy().alias("v"))
    return numeric.coerce_numeric(e, ["v"])


@query("blank_to_null", f"SELECT event_id, nullif({_MESSY}, '') AS v, event_type FROM events")
def _(t):
    return text.blank_to_null(t.events.select("event_id", _messy().alias("v"), "event_type"))


@query("haversine_km", f"""WITH h AS (SELECT c_custkey, pow(sin((radians(-20 + (c_custkey % 90)) - radians(37 + (c_custkey % 400) / 1e2)) / 2), 2)
 + cos(radians(37 + (c_custkey % 400) / 1e2)) * cos(radians(-20 + (c_custkey % 90))) * pow(sin((radians((c_custkey % 360) - 180) - radians(-109 + (c_custkey % 700) / 1e2)) / 2), 2) AS h FROM customer)
SELECT c_custkey, round({KM}, 6) AS km FROM h""")
def _(t):
    k = F.col("c_custkey")
    return t.customer.select(k, F.round(numeric.haversine_km(37 + (k % 400) / 100.0, -109 + (k % 700) / 100.0, -20 + k % 90, k % 360 - 180), 6).alias("km"))


@query("web_mercator", """SELECT c_custkey, round(6378137 * radians(-109 + (c_custkey % 700) / 1e2), 3) AS x,
round(6378137 * ln(tan(pi() / 4 + radians(37 + (c_custkey % 400) / 1e2) / 2)), 3) AS y FROM customer""")
def _(t):
    k = F.col("c_custkey")
    x, y = numeric.web_mercator(37 + (k % 400) / 100.0, -109 + (k % 700) / 100.0)
    return t.customer.select(k, F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _line():
    a, b, c = F.col("l_partkey") % 10, F.col("l_suppkey") % 10, F.col("l_linenumber")
    return [v.cast("double") for v in (a, b, c, c + a, F.col("l_quantity") % 10, F.col("l_quantity") % 7)]


_LINE = "(SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 10 AS x1, l_suppkey % 10 AS y1, l_linenumber AS x2, l_linenumber + l_partkey % 10 AS y2, l_quantity % 10 AS x, l_quantity % 7 AS y FROM lineitem)"


@query("perpendicular_distance", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE
round(abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) END AS d FROM {_LINE}""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(numeric.perpendicular_distance(*_line()), 6).alias("d"))


@query("is_point_on_line", f"SELECT l_orderkey, l_linenumber, l_partkey, (x2 - x1) * (y1 - y) = (x1 - x) * (y2 - y1) AS on_line FROM {_LINE}")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numeric.is_point_on_line(*_line()).alias("on_line"))


@query("round_coord", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 0) AS q FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numeric.round_coord(F.col("l_quantity") / 4, 0).alias("q"))


@query("radii", "SELECT p_partkey, i, round(i * 0.1e0 / 4 * p_size, 9) AS r FROM part, range(5) t(i)")
def _(t):
    return t.part.select("p_partkey", "p_size", F.posexplode(numeric.radii(0.1, 5)).alias("i", "r")).select(
        "p_partkey", F.col("i").cast("long").alias("i"), F.round(F.col("r") * F.col("p_size"), 9).alias("r"))


@query("year_fraction", """SELECT o_orderkey, round((dayofyear(o_orderdate) - 1) / dayofyear(make_date(year(o_orderdate), 12, 31)), 6) AS f FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", F.round(dates.year_fraction(F.to_date("o_orderdate")), 6).alias("f"))


@query("is_leap", """SELECT CAST(year(o_orderdate) AS INTEGER) AS y, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n")).withColumn("leap", dates.is_leap(F.col("y")))


@query("extract_timestamp", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def _(t):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    shown = F.when(F.col("event_type") == "error", "at 2024-02-31 10:00:00").otherwise(F.concat(F.lit("seen ("), stamp, F.lit(") then")))
    return t.events.select("event_id", dates.extract_timestamp(shown).alias("at"))


@query("lenient_date", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE {day_sql('o_orderdate')} END AS d FROM orders")
def _(t):
    shown = F.when(F.col("o_orderstatus") == "F", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", dates.lenient_date(shown).alias("d"))


@query("strict_date", f"SELECT o_orderkey, {day_sql('o_orderdate')} AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.strict_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))


@query("lookback", f"SELECT o_orderkey, {day_sql('o_orderdate - INTERVAL 2562 DAY')} AS a, {day_sql('o_orderdate - INTERVAL 7 DAY')} AS b FROM orders")
def _(t):
    a, b = dates.lookback(F.to_date("o_orderdate"), 7 * 365, 7)
    return t.orders.select("o_orderkey", a.alias("a"), b.alias("b"))


@query("date_series", f"""SELECT p_partkey, {day_sql('d')} AS d FROM (SELECT p_partkey, unnest(generate_series(DATE '2024-02-20', DATE '2024-02-20' + CAST(p_size AS INTEGER), INTERVAL 1 DAY)) AS d FROM part)""")
def _(t):
    start = filters.day("2024-02-20")
    return t.part.select("p_partkey", F.explode(dates.date_series(start, F.date_add(start, F.col("p_size")))).alias("d"))


@query("normalize_name", "SELECT page_id, nullif(lower(replace(url, '/', '-')), '') AS name FROM pages")
def _(t):
    return t.pages.select("page_id", text.normalize_name(F.col("url")).alias("name"))


@query("field_at", "SELECT page_id, split_part(url, '/', 4) AS third, nullif(split_part(url, '/', 9), '') AS eighth FROM pages")
def _(t):
    return t.pages.select("page_id", F.coalesce(text.field_at(F.col("url"), "/", 3), F.lit("")).alias("third"),
                          F.nullif(text.field_at(F.col("url"), "/", 8), F.lit("")).alias("eighth"))


@query("strip_quotes", "SELECT event_id, replace(trim(props), '\"', '') AS p FROM events")
def _(t):
    return t.events.select("event_id", text.strip_quotes(F.concat(F.lit(" "), "props", F.lit(" "))).alias("p"))


@query("with_prefix", "SELECT page_id, CASE WHEN starts_with(url, 'https:') THEN url ELSE 'https:' || url END AS u FROM pages")
def _(t):
    return t.pages.select("page_id", text.with_prefix(F.col("url"), "https:").alias("u"))


@query("is_digits", "SELECT page_id, regexp_full_match(split_part(split_part(url, '/', 5), '?', 1), '[0-9]+') AS digits FROM pages")
def _(t):
    return t.pages.select("page_id", text.is_digits(F.coalesce(text.field_at(text.field_at(F.col("url"), "/", 4), r"\?", 0), F.lit(""))).alias("digits"))


@query("leading_letters", "SELECT p_partkey, upper(substring(split_part(p_name, ' ', 1), 1, 2)) AS c FROM part")
def _(t):
    return t.part.select("p_partkey", text.leading_letters(F.col("p_name")).alias("c"))


@query("json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("first_where", "SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN 'high' WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 20 THEN 'mid' END AS v FROM events")
def _(t):
    k = F.from_json("props", "k long")["k"]
    arr = F.array(F.struct((k - 50).alias("n"), F.lit("high").alias("value")), F.struct((k - 20).alias("n"), F.lit("mid").alias("value")))
    return t.events.select("event_id", nested.first_where(arr, lambda e: e["n"] > 0, "value").alias("v"))


@query("first_nested", "SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM events")
def _(t):
    inner = F.when(F.col("event_type") == "view", F.array().cast("array<double>")).otherwise(F.array("value", F.lit(0.0)))
    return t.events.select("event_id", nested.first_nested(F.array(F.struct(inner.alias("value"))), "value").alias("v"))


@query("point_request_ok", """SELECT event_id, event_type = 'view' AND value <= 90 AS ok FROM events""")
def _(t):
    e, v = F.col("event_type"), F.col("value").cast("string")
    place = (F.when(e.isin("view", "purchase"), F.concat(v, F.lit(",-105.5"))).when(e == "click", F.concat(F.lit("abc,"), v))
             .when(e == "error", F.concat(F.lit("40,-20"), v)).otherwise(v))
    when = F.when(e == "purchase", "07/30/2022").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select("event_id", nested.point_request_ok(place, when).alias("ok"))
