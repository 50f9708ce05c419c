"""Readers on landed files, with the inputs of the fixtures, and the writers."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from freshet.operators import filters, flows, grids, snow
from freshet.sources import flow, grids as grid_source, sinks, snow as snow_source, stations, watershed, weather


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))
    return path


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_instantaneous_flow(spark, landing):
    head = "# Some comment\nagency_cd\tsite_no\tdatetime\ttz_cd\t1_00060\n5s\t15s\t20d\t6s\t14n\n"
    good = "USGS\t07094500\t2022-05-01 00:00\tMDT\t15.0\tP\nUSGS\t07094500\t2022-05-01 01:00\tMDT\t20.0\tP\n"
    put(landing, "a/one.rdb", head + good + "USGS\t07094500\tNotADate\tMDT\t1\tP\nUSGS\t07094500\t2022-05-01 02:00\tMDT\tIce\tP\nshort\tline\n")
    daily = flows.daily_extremes(flow.read_flow_rdb(spark, f"{landing}/a"))
    assert rows(daily) == [("07094500", dt.date(2022, 5, 1), 15.0, 20.0)]
    assert flow.read_flow_rdb(spark, f"{landing}/a", strict=True).count() == 0
    put(landing, "b/none.rdb", "# Some comment\n")
    assert flow.read_flow_rdb(spark, f"{landing}/b").count() == 0
    put(landing, "c/bad.rdb", "USGS\t1\tNotADate\tMDT\tNotAFlow\n")
    assert flow.read_flow_rdb(spark, f"{landing}/c").count() == 0


def test_hourly_flow(spark, landing):
    def docs(*pairs):
        return {"ResultList": [{"measDate": d, "measValue": v} for d, v in pairs]}

    put(landing, "ARKCANCO.json", docs(("2022-05-01 00:00:00", 10), ("2022-05-01 01:00:00", "20")))
    put(landing, "EMPTY.json", docs())
    put(landing, "MISSING.json", {"other": 1})
    put(landing, "BAD.json", docs(("This is not a date", "Not a number"), ("2022-05-01 00:00:00", "3")))
    lenient = flows.daily_extremes(flow.read_flow_json(spark, landing))
    assert rows(lenient, "station_id") == [("ARKCANCO", dt.date(2022, 5, 1), 10.0, 20.0), ("BAD", dt.date(2022, 5, 1), 3.0, 3.0)]
    assert {r.station_id for r in flow.read_flow_json(spark, landing, strict=True).collect()} == {"ARKCANCO"}


def test_coordinates(spark, landing):
    path = put(landing, "sites.rdb", "\n# comment\nsite_no\tstation_nm\tdec_lat_va\tdec_long_va\n15s\t50s\t16s\t16s\n"
               "12345678\tTest Station\t40.123456\t-105.654321\n07094500\tArkansas\t38.4872189\t-105.373604\n")
    assert rows(flow.read_site_inventory(spark, path), "site_id") == [("07094500", 38.4872189, -105.373604), ("12345678", 40.123456, -105.654321)]
    path = put(landing, "agency.tsv", "# c\nabbrev\tlatitude\tlongitude\n\nTESTABBR\t39.987654\t-104.123456\n")
    assert rows(flow.read_agency_coordinates(spark, path)) == [("TESTABBR", 39.987654, -104.123456)]
    assert flow.read_agency_coordinates(spark, put(landing, "empty.tsv", "")).count() == 0
    assert rows(flow.read_sites(spark, put(landing, "ids.txt", "USGS:1 \n\n DWR:X\n")), "value") == [("DWR:X",), ("USGS:1",)]


def test_weather(spark, landing):
    path = put(landing, "stations.txt", "USW00000001  40.1 -105.2 1655.0 CO BOULDER\nCA000000002 50 -100 1 X\n\n")
    assert rows(weather.read_wx_stations(spark, path), "wx_id") == [("CA000000002", 50.0, -100.0), ("USW00000001", 40.1, -105.2)]
    path = put(landing, "meta.json", '{"id":"GHCND:USW1","datacoverage":0.9,"mindate":"2000-01-01","maxdate":"2024-01-01"}\n{"id":"USW2","datacoverage":1}\n')
    assert rows(weather.read_wx_meta(spark, path), "wx_id") == [
        ("GHCND:USW1", .9, dt.date(2000, 1, 1), dt.date(2024, 1, 1)), ("GHCND:USW2", 1.0, None, None)]
    path = put(landing, "fields.json", '{"station":"USW1","dataTypes":{"buckets":[{"key":"TMIN"},{"key":"TMAX"}]}}\n{"station":"USW2"}\n')
    assert rows(weather.read_wx_fields(spark, path), "datatype") == [("USW1", "TMAX"), ("USW1", "TMIN")]
    path = put(landing, "daily.csv", '"STATION","DATE","TMAX","TMIN"\n"USW1","2024-01-01","  40","-3"\n"USW1","2024-01-02","","x"\n')
    assert rows(weather.read_wx_daily(spark, path), "date") == [("USW1", dt.date(2024, 1, 1), -3.0, 40.0), ("USW1", dt.date(2024, 1, 2), None, None)]
    bad = put(landing, "bad.csv", "STATION,DATE,TMAX,TMIN\nUSW1,someday,1,2\n")
    with pytest.raises(Exception):
        weather.read_wx_daily(spark, bad).collect()


def test_station_catalogues(spark, landing):
    usgs = {"value": {"timeSeries": [
        {"sourceInfo": {"siteName": "A", "siteCode": [{"value": "9", "agencyCode": "COE"}, {"value": "07", "agencyCode": "USGS"}],
                        "geoLocation": {"geogLocation": {"latitude": 1.5, "longitude": -2.5}},
                        "siteProperty": [{"name": "stateCd", "value": "08"}]},
         "variable": {"unit": {"unitCode": "ft3/s"}}, "values": [{"value": [{"value": "12.5", "dateTime": "2024"}]}]},
        {"sourceInfo": {"siteName": "B", "siteCode": [{"value": "9", "agencyCode": "COE"}], "geoLocation": {"geogLocation": {}}, "siteProperty": []},
         "variable": {"unit": {}}, "values": [{"value": []}]}]}}
    got = {r.name: r for r in stations.read_stations(spark, put(landing, "u/usgs.json", usgs), "USGS").collect()}
    assert (got["A"].id, got["A"].usgs_site_id, got["A"].state, got["A"].county, got["A"].last_reading) == ("07", "07", "08", None, 12.5)
    assert got["B"].id is None and got["B"].last_reading is None and got["B"].data_source == "USGS"
    dwr = {"ResultList": [{"stationNum": 5, "abbrev": "ARK", "latitude": 38.1, "measUnit": "cfs"}]}
    one = stations.read_stations(spark, put(landing, "d/dwr.json", dwr), "DWR").first()
    assert (one.id, one.abbreviation, one.latitude, one.longitude, one.measurement_unit) == ("5", "ARK", 38.1, None, "cfs")
    assert len(one) == 16
    with pytest.raises(ValueError):
        stations.read_stations(spark, landing, "EPA")


def test_snow(spark, landing):
    doc = [{"date": "02-29", "2023": 1.0, "2024": 2.0, "Median": 9}, {"date": "03-01", "2023": None, "2024": 4, "20x4": 1}]
    put(landing, "swe/gunnison.json", doc)
    wide = snow_source.read_swe_wide(spark, f"{landing}/swe")
    assert rows(snow.swe_to_daily(wide, "2023-01-01", "2024-12-31"), "date") == [("gunnison", dt.date(2024, 2, 29), 2.0), ("gunnison", dt.date(2024, 3, 1), 4.0)]
    assert [r.years for r in snow.year_values(wide, 2024, 2030).orderBy("month_day").collect()] == [{"2024": 2.0}, {"2024": 4.0}]
    with pytest.raises(ValueError):
        snow.swe_to_daily(wide, "2024-01-01", "2023-01-01")
    st = snow_source.read_snow_stations(spark, put(landing, "st.json", '{"stationTriplet":"1:CO:SNTL","huc":"140801040101"}\n{"huc":"14"}\n'))
    daily = snow_source.read_snow_daily(spark, put(landing, "d.json", '{"stationTriplet":"1:CO:SNTL","data":[{"values":[{"date":"2020-01-01","value":3.5},{"date":"2022-01-01","value":1}]}]}\n'
                                                   '{"stationTriplet":"2:CO:SNTL","data":[{"values":[{"date":"2020-01-01","value":1}]}]}\n'))
    assert rows(snow.snow_for_huc(st, daily, "14080104", "2019-10-01", "2021-09-30")) == [("1:CO:SNTL", dt.date(2020, 1, 1), 3.5)]
    report = snow_source.read_snow_report(spark, put(landing, "r.csv", "# c,1\nDate,Value\n2020-01-01,3.5\n2020-01-02,\n2020-01-03,1.2.3\nno comma\n2020-01-04,-1\n"))
    assert rows(report) == [(dt.date(2020, 1, 1), 3.5)]
    assert snow_source.basin_dim(spark).groupBy("basin_type").count().orderBy("basin_type").collect()[0]["count"] == 8


def test_watershed_polygons(spark, landing):
    ring = [[0, 0], [1, 0], [1, 1], [0, 1]]
    doc = {"features": [{"geometry": {"rings": [ring, ring]}, "attributes": {"huc8": "14020001", "huc2": "14", "name": "East-Taylor"}},
                        {"geometry": {"rings": [ring]}, "attributes": {"huc8": "2"}}]}
    path = put(landing, "h.json", doc)
    one = watershed.read_huc_polygons(spark, path, 8, first_only=True).collect()
    assert [(r.huc_id, [(p.lon, p.lat) for p in r.ring]) for r in one] == [("14020001", [(0, 0), (1, 0), (1, 1), (0, 1)])]
    assert watershed.read_huc_polygons(spark, path, 8).count() == 2
    assert watershed.read_huc_polygons(spark, path, 4, first_only=True).first().huc_id == "14EA"
    assert watershed.read_huc_polygons(spark, put(landing, "e.json", {"error": 500}), 8).count() == 0
    geo = {"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"huc6": "140200", "name": "G"}}]}
    assert watershed.read_watershed_geojson(spark, put(landing, "g.json", geo), 6).first().huc_id == "140200"
    with pytest.raises(ValueError):
        watershed.read_huc_polygons(spark, path, 10)


def test_grid_cells_prune_by_date_and_pick_the_first_group(spark, landing):
    cells = [("g1", dt.date(2020, 1, 1), 0, 0, 45.0, -120.0, .3, "Metadata", 0), ("g1", dt.date(2020, 1, 1), 0, 0, 45.0, -120.0, .4, "Soil_Moisture_Retrieval_Data_AM", 1),
             ("g1", dt.date(2020, 1, 1), 0, 1, -9999.0, -9999.0, -9999.0, "Soil_Moisture_Retrieval_Data_AM", 1), ("g1", dt.date(2020, 1, 1), 0, 0, 45.0, -120.0, .5, "Soil_Moisture_Retrieval_Data_PM", 2),
             ("g2", dt.date(2020, 1, 2), 0, 0, 46.0, -121.0, .6, "Soil_Moisture_Retrieval_Data_PM", 2), ("g3", dt.date(2020, 1, 9), 0, 0, 46.0, -121.0, .7, "Soil_Moisture_Retrieval_Data_AM", 1)]
    path = f"{landing}/cells"
    spark.createDataFrame(cells, "grid_id string, ts date, row int, col int, lat double, lon double, value double, grp string, group_order int").write.partitionBy("ts").parquet(path)
    got = grid_source.read_moisture_cells(spark, path, "2020-01-01", "2020-01-03")
    assert rows(got.select("grid_id", "lat", "value"), "grid_id", "lat") == [("g1", None, None), ("g1", 45.0, .4), ("g2", 46.0, .6)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ts" in plan
    bounds = {r.grid_id: (r.min_lon, r.min_lat, r.max_lon, r.max_lat) for r in grids.grid_bounds(grid_source.read_grid_cells(spark, path)).collect()}
    assert bounds["g1"] == (-120.0, 45.0, -120.0, 45.0)


def test_catalogues(spark, landing):
    path = put(landing, "p.json", [{"ProductAndVersion": "SPL3SMP_E.006", "Description": "Daily Soil Moisture"}, {"ProductAndVersion": "X.1"}])
    from freshet.operators.filters import find_products, latest_scene, pick_layer
    assert [r.product for r in find_products(grid_source.read_product_catalog(spark, path)).collect()] == ["SPL3SMP_E.006"]
    put(landing, "layers/SPL3SMP_E.json", {"z_flag": {"Description": "Flag"}, "b_soil_moisture": {"Description": "x"}, "a": {"Description": "Soil_Moisture am"}})
    assert rows(pick_layer(grid_source.read_product_layers(spark, f"{landing}/layers")).select("product", "layer")) == [("SPL3SMP_E", "b_soil_moisture")]
    path = put(landing, "s.json", '{"dataset":"d","results":[{"entityId":"a","acquisitionDate":"2024-01-01"},{"entityId":"b","acquisitionDate":"2024-01-20"},{"entityId":"c","acquisitionDate":"2024-02-20"}]}\n')
    assert rows(latest_scene(grid_source.read_scenes(spark, path), "2024-01-25").select("scene_id")) == [("b",)]


def test_writers_keep_every_row(spark, landing):
    df = spark.range(500).select(F.concat(F.lit("USGS:"), (F.col("id") % 7).cast("string")).alias("station_id"),
                                 F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.rand(1).alias("tmin"))
    sinks.write_combined(df, f"{landing}/combined", buckets=4)
    back = spark.read.parquet(f"{landing}/combined")
    assert back.drop("station_bucket").exceptAll(df).count() == 0 and back.count() == 500
    assert len([d for d in os.listdir(f"{landing}/combined") if d.startswith("station_bucket=")]) <= 4
    sinks.write_combined(df, f"{landing}/csv", fmt="csv")
    assert spark.read.csv(f"{landing}/csv", header=True).count() == 500
    sinks.write_normalized(df.drop("date"), f"{landing}/normalized")
    assert spark.read.parquet(f"{landing}/normalized").columns == ["station_id", "tmin"]


def test_some_stations_replace_theirs(spark, landing):
    schema = "station_id string, date date, min_flow double"
    rows_ = [(f"s{k}", dt.date(2024, m, 1), float(k)) for k in range(20) for m in (1, 2)]
    for fmt in ("parquet", "csv"):
        path = f"{landing}/{fmt}-parts"
        first = spark.createDataFrame(rows_, schema)
        sinks.write_combined(first, path, fmt, "stations", buckets=4)  # nothing there yet
        sinks.write_combined(spark.createDataFrame([("s3", dt.date(2024, 5, 1), None), ("new", dt.date(2024, 5, 1), 9.0)], schema), path, fmt, "stations", buckets=4)
        sinks.write_combined(first.limit(0), path, fmt, "stations", buckets=4)
        got = {tuple(r) for r in sinks.read_combined(spark, path, first.schema, fmt).collect()}
        assert got == {r for r in rows_ if r[0] != "s3"} | {("s3", dt.date(2024, 5, 1), None), ("new", dt.date(2024, 5, 1), 9.0)}


def test_granules_of_any_type(spark, landing):
    text = "granule_id,min_lon,min_lat,max_lon,max_lat,start,end,size_mb\n" \
           "a,1,2,3,4,2024-01-01T10:00:00-07:00,2024-01-02,5\nb,1,2,3,4,2024-01-01 10:00:00,2024-01-02T00:00:00Z,\n" \
           "c,x,2,3,4,2024-01-01,2024-01-02,1\nd,9,2,3,4,2024-01-01,2024-01-02,1\n,1,2,3,4,2024-01-03,2024-01-02,big\n"
    spark.conf.set("spark.sql.session.timeZone", "America/Denver")
    try:
        good, bad = grid_source.read_granules(spark, put(landing, "g.csv", text), "csv")
        at = {r.granule_id: (r.s, r.e, r.size_mb) for r in good.selectExpr("*", "unix_seconds(start) AS s", "unix_micros(end) AS e").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert at == {"a": (1704128400, 1704239999999999, 5.0), "b": (1704103200, 1704153600000000, None)}
    assert {r.granule_id: r.reason for r in bad.collect()} == {"c": "min_lon", "d": "max_lon", None: "size_mb,granule_id,end"}
    assert '"min_lon":"x"' in bad.where("granule_id = 'c'").first().landed
    typed = spark.createDataFrame([(7, 1.0, float("nan"), dt.date(2024, 1, 1), dt.date(2024, 1, 1))], "granule_id int, min_lon double, min_lat double, start date, end date")
    typed.write.parquet(f"{landing}/typed")
    good, bad = grid_source.read_granules(spark, f"{landing}/typed")
    assert good.count() == 0 and bad.first().reason == "min_lat,max_lon,max_lat"
    assert grid_source.parse_granules(typed.limit(0))[0].count() == 0


def test_ranges_take_the_whole_last_day(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-02 00:00:00'), (2, timestamp'2024-01-03 23:59:59.999999'), (3, timestamp'2024-01-04 00:00:00'), (4, NULL) AS t(id, ts)")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    assert ids(filters.date_range(df, "2024-01-02", "2024-01-03", "ts")) == [1, 2]
    assert ids(filters.date_range(df, dt.date(2024, 1, 3), dt.datetime(2024, 1, 4), "ts")) == [2, 3]
    days = df.withColumn("ts", F.col("ts").cast("date"))
    assert ids(filters.date_range(days, "2024-01-02 12:00:00", "2024-01-03 01:00:00", "ts")) == [1, 2]
    with pytest.raises(ValueError):
        filters.date_range(df, "2024-01-02", "2024-01-01", "ts")


def _layer(n, first="properties"):
    def feature(i):
        ring = [[i * 1.0, 0.0], [i + 1.0, 0.0], [i + 1.0, 1.0 + i % 3], [i * 1.0, 0.0]]
        parts = {"properties": {"huc8": f"{i:08d}", "name": "a } , { ] " + "x" * (i % 50), "huc2": "14"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        return {"type": "Feature", **{k: parts[k] for k in (first, *(set(parts) - {first}))}}
    return {"type": "FeatureCollection", "features": [feature(i) for i in range(n)], "more": {"type": "x"}}


@pytest.mark.parametrize("layout", [{"indent": 1}, {"separators": (",", ":")}, {}])
def test_layers_are_read_in_pieces(spark, landing, layout):
    path = os.path.join(landing, "layer.json")
    with open(path, "w") as f:
        json.dump(_layer(2000, "geometry" if layout else "properties"), f, **layout)
    whole = watershed.parse_watershed_geojson(spark.read.schema(watershed.GEOJSON).json(path, multiLine=True), 8)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        split = watershed.read_watershed_geojson(spark, path, 8)
        assert split.rdd.getNumPartitions() > 2
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and split.count() == 2000
        assert watershed.read_features(spark, path, watershed.GEOJSON).select(F.max(F.size("features"))).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_layers_that_cannot_be_split(spark, landing):
    odd = _layer(3)
    odd["features"][1] = {"id": 5, **{k: odd["features"][1][k] for k in ("geometry", "properties")}}  # opens in another way
    assert watershed.read_watershed_geojson(spark, put(landing, "odd.json", odd), 8).count() == 3
    assert watershed.read_watershed_geojson(spark, put(landing, "none.json", {"type": "FeatureCollection", "features": []}), 8).count() == 0
    esri = {"features": [{"attributes": {"huc8": f"{i}", "name": "n"}, "geometry": {"rings": [[[0, 0], [1, 0], [1, 1]]]}} for i in range(50)]}
    assert watershed.read_huc_polygons(spark, put(landing, "esri.json", esri), 8).count() == 50
