"""The registry, and the tables in the shape the operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; dates and times come out as text so that engines agree on them."""
    def register(fn):
        QUERIES[name] = lambda spark, folder: as_text(fn(Tables(spark, folder)))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def as_text(df: DataFrame) -> DataFrame:
    shown = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            shown[f.name] = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            shown[f.name] = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(shown) if shown else df


def day_sql(expr: str) -> str:
    return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d')"


def lattice(key: Column, rows: int, cols: int) -> tuple[Column, Column]:
    """Spread keys over a grid of hundredths of a degree; (lat, lon)."""
    return F.lit(37) + (key % rows) / F.lit(100.0), F.lit(-109) + (key % cols) / F.lit(100.0)


def lattice_sql(key: str, rows: int, cols: int) -> str:
    return f"37 + ({key} % {rows}) / 1e2 AS lat, -109 + ({key} % {cols}) / 1e2 AS lon"


# A concave eight-pointed outline, scaled and moved for every supplier.
OUTLINE = ((-3, -3), (0, -1), (3, -3), (1, 0), (3, 3), (0, 1), (-3, 3), (-1, 0))
RINGS_SQL = f"""outline(i, dx, dy) AS (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(OUTLINE))}),
vertex AS (SELECT s_suppkey AS k, i,
    (-109 + (s_suppkey * 7 % 700) / 1e2 + 0.00371e0) + dx * (0.02e0 + (s_suppkey % 7) / 1e2) AS x,
    (37 + (s_suppkey * 3 % 400) / 1e2 + 0.00293e0) + dy * (0.02e0 + (s_suppkey % 7) / 1e2) AS y FROM supplier, outline),
edge AS (SELECT a.k, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
    FROM vertex a JOIN vertex b ON a.k = b.k AND b.i = (a.i + 1) % {len(OUTLINE)})"""

CELLS_SQL = """cell AS (SELECT o_orderkey AS id, 37 + (o_orderkey % 397) / 1e2 AS lat, -109 + (o_orderkey % 691) / 1e2 AS lon,
    CAST(o_orderdate AS DATE) AS ts, o_orderstatus AS grid_id, CASE WHEN o_totalprice < 20000 THEN NULL ELSE floor(o_totalprice) END AS value FROM orders)"""

# Even-odd test of every cell against every ring, boundary points out, and the
# squared distance to the boundary.
PAIRS_SQL = f"""WITH {RINGS_SQL}, {CELLS_SQL},
pair AS (SELECT c.id, e.k, any_value(c.lat) AS lat, any_value(c.lon) AS lon, any_value(c.ts) AS ts, any_value(c.grid_id) AS grid_id,
    any_value(c.value) AS value,
    count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon) % 2 = 1 AS inside,
    min(pow(lon - (x1 + greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (x2 - x1)), 2)
      + pow(lat - (y1 + greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (y2 - y1)), 2)) AS d2
    FROM cell c, edge e GROUP BY c.id, e.k)"""


class Tables:
    """The given tables, and views of them in the operators' shape."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def readings(self, key: str = "user_id") -> DataFrame:
        return self.events.select(F.col(key).cast("string").alias("station_id"), "ts", F.col("value").alias("flow"), "event_type")

    def gappy_daily(self) -> DataFrame:
        """Daily temperatures per user, some missing."""
        return (self.events.groupBy(F.col("user_id").cast("string").alias("station_id"), F.to_date("ts").alias("date"))
                .agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
                .select("station_id", "date", F.when(F.col("_lo") >= 4, F.col("_lo")).alias("tmin"),
                        F.when(F.col("_hi") <= 60, F.col("_hi")).alias("tmax")))

    def sites(self) -> DataFrame:
        lat, lon = lattice(F.col("s_suppkey"), 400, 700)
        return self.supplier.select(F.col("s_suppkey").cast("string").alias("site_id"), lat.alias("lat"), lon.alias("lon"))

    def wx_stations(self) -> DataFrame:
        lat, lon = lattice(F.col("c_custkey"), 400, 700)
        return self.customer.select(
            F.concat(F.when(F.col("c_mktsegment") == "MACHINERY", "CAN").otherwise("USW"),
                     F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("wx_id"), lat.alias("lat"), lon.alias("lon"))

    def wx_meta(self) -> DataFrame:
        first = self.orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("mindate"),
                                                     F.max(F.to_date("o_orderdate")).alias("maxdate"),
                                                     F.max("o_totalprice").alias("_p"))
        return first.select(F.concat(F.lit("GHCND:USW"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("wx_id"),
                            (F.col("_p") / 500000.0).alias("datacoverage"), "mindate", "maxdate")

    def wx_fields(self) -> DataFrame:
        kind = F.when(F.col("o_orderstatus") == "F", "TMIN").when(F.col("o_orderstatus") == "O", "TMAX").otherwise("PRCP")
        return self.orders.select(F.concat(F.lit("USW"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("wx_id"),
                                  kind.alias("datatype"))

    def rings(self) -> DataFrame:
        """A watershed per supplier: (polygon_id, ring), the ring not closed."""
        k = F.col("s_suppkey")
        cx = F.lit(-109) + (k * 7 % 700) / F.lit(100.0) + F.lit(0.00371)
        cy = F.lit(37) + (k * 3 % 400) / F.lit(100.0) + F.lit(0.00293)
        r = F.lit(0.02) + (k % 7) / F.lit(100.0)
        points = [F.struct((cx + F.lit(a) * r).alias("lon"), (cy + F.lit(b) * r).alias("lat")) for a, b in OUTLINE]
        return self.supplier.select(k.alias("polygon_id"), F.array(*points).alias("ring"))

    def hucs(self) -> DataFrame:
        """The rings as watersheds of the levels 4, 6 and 8."""
        named = self.supplier.select(F.col("s_suppkey").alias("polygon_id"), F.col("s_name").alias("name"),
                                     F.col("s_nationkey").alias("n"))
        return self.rings().join(named, "polygon_id").select(
            F.when(F.col("n") < 5, 4).when(F.col("n") < 10, 6).otherwise(8).alias("huc_level"),
            F.lpad(F.col("polygon_id").cast("string"), 8, "0").alias("huc_id"), "name", "ring")

    def cells(self) -> DataFrame:
        """A grid cell per order."""
        lat, lon = lattice(F.col("o_orderkey"), 397, 691)
        return self.orders.select(
            F.col("o_orderkey").alias("id"), lat.alias("lat"), lon.alias("lon"), F.to_date("o_orderdate").alias("ts"),
            F.col("o_orderstatus").alias("grid_id"),
            F.when(F.col("o_totalprice") >= 20000, F.floor("o_totalprice").cast("double")).alias("value"))
