"""Landed grids (long cell tables) and the catalogues that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.numeric import nan_to_null
from freshet.operators.filters import date_range, fill_to_null
from freshet.operators.grids import MOISTURE_GROUP, first_group_cells

FILL = -9999.0


def parse_grid_cells(cells: DataFrame, fill: float | Column = FILL) -> DataFrame:
    """Fill values and NaN become NULL; a ``nodata`` column, if any, is the grid's own fill value."""
    cols = [c for c in ("lat", "lon", "value") if c in cells.columns]
    out = fill_to_null(cells.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in cols}), cols, fill)
    if "nodata" in cells.columns:
        out = fill_to_null(out, ["value"], F.col("nodata")).drop("nodata")
    return out


def read_grid_cells(spark: SparkSession, path, start=None, end=None, group: str | None = None) -> DataFrame:
    """Parquet cells, partitioned by ``ts`` so that a date range prunes files.

    ``group`` keeps, per grid, the first group whose name contains it.
    """
    cells = spark.read.parquet(path)
    if start is not None:
        cells = date_range(cells, start, end, date="ts")
    cells = parse_grid_cells(cells)
    return cells if group is None else first_group_cells(cells, group)


def read_moisture_cells(spark: SparkSession, path, start=None, end=None) -> DataFrame:
    return read_grid_cells(spark, path, start, end, MOISTURE_GROUP)


PRODUCTS = """ProductAndVersion string, Description string, Available string, TemporalExtentStart string,
TemporalExtentEnd string, Resolution string, Source string"""


def read_product_catalog(spark: SparkSession, path) -> DataFrame:
    docs = spark.read.schema(PRODUCTS).json(path, multiLine=True)
    return docs.select(F.col("ProductAndVersion").alias("product"), F.col("Description").alias("description"),
                       F.col("Available").alias("available"), F.col("TemporalExtentStart").alias("extent_start"),
                       F.col("TemporalExtentEnd").alias("extent_end"), F.col("Resolution").alias("resolution"),
                       F.col("Source").alias("source"))


def parse_product_layers(docs: DataFrame, value: str = "value", product: str = "product") -> DataFrame:
    """{layer: {Description: ...}, ...} documents to (product, ordinal, layer, description), in document order."""
    layers = docs.select(F.col(product).alias("product"), F.from_json(value, "map<string,struct<Description:string>>").alias("m"))
    return layers.select("product", F.posexplode(F.map_entries("m")).alias("ordinal", "e")).select(
        "product", "ordinal", F.col("e.key").alias("layer"), F.col("e.value.Description").alias("description"))


def read_product_layers(spark: SparkSession, path) -> DataFrame:
    """One document per product; the file's name is the product."""
    docs = spark.read.text(path, wholetext=True).select(
        "value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("product"))
    return parse_product_layers(docs)


#: What a granule catalogue lists, as what it is used.
GRANULES = {"granule_id": "string", "min_lon": "double", "min_lat": "double", "max_lon": "double", "max_lat": "double",
            "start": "timestamp", "end": "timestamp", "size_mb": "double"}
_ZONE = r"(Z|[+-]\d{2}:?\d{2}|UTC|GMT)\s*$"
_DAY_ONLY = r"^\s*\d{4}-\d{2}-\d{2}\s*$"


def _utc(text: Column, last: bool) -> Column:
    """A moment from text: without a zone it is in UTC; a day alone is its first moment or, as an end, its last."""
    zoned = F.when(F.rlike(text, F.lit(_ZONE)), text).otherwise(F.concat(F.trim(text), F.lit("Z")))
    day_only = F.rlike(text, F.lit(_DAY_ONLY))
    at = F.when(day_only, F.concat(F.trim(text), F.lit("T00:00:00Z"))).otherwise(zoned).try_cast("timestamp")
    return F.when(day_only, at + F.expr("INTERVAL '1' DAY - INTERVAL '0.000001' SECOND")).otherwise(at) if last else at


def parse_granules(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(granules, rejected) from landed rows whose columns have any type.

    Granules have the columns and types of ``GRANULES``; a column that wasn't
    landed is NULL.  Text with a zone is that moment, without one it is in UTC,
    whatever the session's zone.  A row is rejected if a field has a value that
    isn't one of its type, if it has no id, box or range, or if its box or range
    is reversed; it comes back with ``reason``, the fields at fault, and
    ``landed``, its fields as JSON.  A missing size stays NULL.
    """
    there = {c: F.col(f"`{c}`") for c in GRANULES if c in rows.columns}
    kinds = dict(rows.dtypes)

    def settled(c: str) -> Column:
        if c not in there:
            return F.lit(None).cast(GRANULES[c])
        if GRANULES[c] == "timestamp":
            # Only text leaves the zone and the day's end open.
            return _utc(there[c], c == "end") if kinds[c] == "string" else _utc(there[c].cast("string"), c == "end") if kinds[c] == "date" else there[c].try_cast("timestamp")
        if GRANULES[c] == "double":
            value = F.nullif(F.trim(there[c].cast("string")), F.lit("")).try_cast("double")
            return F.when(~F.isnan(value), value)
        return F.nullif(F.trim(there[c].cast("string")), F.lit(""))

    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])) if rows.columns else F.lit("{}")
    typed = rows.select(*[settled(c).alias(c) for c in GRANULES], whole.alias("landed"),
                        *[there[c].cast("string").alias(f"_raw_{c}") for c in there])
    faults = [F.when(F.col(c).isNull() & (F.trim(F.col(f"_raw_{c}")) != ""), F.lit(c)) for c in there]
    faults += [F.when(F.col(c).isNull(), F.lit(c)) for c in GRANULES if c != "size_mb"]
    faults += [F.when(F.col(a) > F.col(b), F.lit(b)) for a, b in (("min_lon", "max_lon"), ("min_lat", "max_lat"), ("start", "end"))]
    marked = typed.withColumn("reason", F.array_join(F.array_distinct(F.array_compact(F.array(*faults))), ","))
    return (marked.where("reason = ''").select(*GRANULES), marked.where("reason <> ''").select("granule_id", "reason", "landed"))


def read_granules(spark: SparkSession, path, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(granules, rejected) of a landed catalogue; text formats are read by the declared columns, each field as it was landed."""
    reader = spark.read.format(fmt)
    if fmt == "parquet":
        return parse_granules(reader.load(path))
    reader = reader.schema(", ".join(f"{c} string" for c in GRANULES))
    return parse_granules((reader.option("header", True).option("enforceSchema", False) if fmt == "csv" else reader).load(path))


def read_scenes(spark: SparkSession, path) -> DataFrame:
    """Scene search answers, one per line: ``results`` of one dataset."""
    docs = spark.read.schema("dataset string, results array<struct<entityId:string,acquisitionDate:string>>").json(path)
    return docs.select("dataset", F.explode("results").alias("r")).select(
        "dataset", F.col("r.entityId").alias("scene_id"), F.col("r.acquisitionDate").try_cast("date").alias("acquisition_date"))
