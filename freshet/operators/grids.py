"""Gridded values: bounds, availability, and means over polygons.

Cells are a long table (grid_id, ts, row, col, lat, lon, value); missing values
are NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.numeric import col, radii
from freshet.operators.filters import valid_cells
from freshet.operators.joins import SALTS, Salts, dealt_out, equi_join, lookup, unsent
from freshet.operators.staging import shared
from freshet.operators.spatial import match_overlaps, match_polygons, match_totals, within_distance

# Fixed value: what the name of a soil-moisture group contains.
MOISTURE_GROUP = "Soil_Moisture_Retrieval_Data"


def first_group_cells(cells: DataFrame, name_part: str = MOISTURE_GROUP, group: str = "grp",
                      order: str = "group_order", salts: Salts = SALTS) -> DataFrame:
    """Per grid, the cells of the first group whose name contains ``name_part``."""
    named = cells.where(F.contains(col(group), F.lit(name_part)))
    first = named.groupBy("grid_id").agg(F.min(col(order)).alias(order))
    return lookup(named, first, ["grid_id", order], how="left_semi", salts=salts)


def grid_bounds(cells: DataFrame, group: str = "grp") -> DataFrame:
    """Extent of the located cells of each grid, from its first group that has any."""
    sides = [F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"),
             F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat")]
    per_group = (cells.groupBy("grid_id", col(group)).agg(*sides)
                      .where(F.col("min_lon").isNotNull() & F.col("min_lat").isNotNull()))
    box = F.struct(col(group), "min_lon", "min_lat", "max_lon", "max_lat")
    return per_group.groupBy("grid_id").agg(F.min_by(box, col(group)).alias("_b")).select("grid_id", "_b.*")


def grid_availability(cells: DataFrame, boxes: DataFrame, margin: float = 1.0,
                      id_col: str = "polygon_id", salts: Salts = SALTS) -> DataFrame:
    """Cells and valid cells in each box, and valid cells in the box grown by ``margin``.

    A box with no cell near it has a row without ``grid_id``: no cells, and no share that is valid.
    No box meets all its cells: what lies wholly inside is counted by squares (:func:`box_counts`).
    """
    inner = [col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    grown = [inner[0] - margin, inner[1] - margin, inner[2] + margin, inner[3] + margin]
    kinds = [F.struct(F.lit(k).alias("inner"), *[v.alias(c) for v, c in zip(b, ("x0", "y0", "x1", "y1"))]) for k, b in ((True, inner), (False, grown))]
    asked = boxes.select(col(id_col), F.inline(F.array(*kinds)))
    counts = box_counts(cells.select("grid_id", "lon", "lat", "value"), asked, salts)
    in_box = F.col("inner")
    out = counts.groupBy(col(id_col), "grid_id").agg(
        F.sum(F.when(in_box, F.col("_n")).otherwise(0)).alias("total"), F.sum(F.when(in_box, F.col("_valid")).otherwise(0)).alias("valid"),
        F.sum(F.when(~in_box, F.col("_valid")).otherwise(0)).alias("valid_around"))
    every = boxes.select(col(id_col)).distinct().join(out, id_col, "left").fillna(0, ["total", "valid", "valid_around"])
    return every.withColumn("pct_valid", F.try_divide(F.col("valid") * 100.0, F.col("total")))


#: Places of cells that a square of the finest size holds on average, and how often squares are put together four by four.
_CELLS_IN_SQUARE, _SQUARE_LEVELS = 64, 8


def box_counts(cells: DataFrame, boxes: DataFrame, salts: Salts = SALTS) -> DataFrame:
    """Cells (``_n``) and valid cells (``_valid``) of each grid in closed boxes (x0, y0, x1, y1), in several rows per box.

    Cells of one place, as at many times, are counted as one.  They are counted once
    per square, of a finest size by their density and of larger ones up.  A box
    takes the largest squares that lie wholly in it, and tests place by place only
    in the finest squares along its sides.
    """
    there = cells.where(~F.isnan("lon") & ~F.isnan("lat")).groupBy("grid_id", "lon", "lat")
    placed = shared(there.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("value").isNotNull()).alias("_valid")), "places")
    seen = placed.agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"), F.count("lon").alias("n")).first()
    finest = -20
    if seen.n:
        area = max(seen.x1 - seen.x0, 2.0 ** -10) * max(seen.y1 - seen.y0, 2.0 ** -10)
        finest = max(finest, round(math.log2(area * _CELLS_IN_SQUARE / seen.n) / 2))
    x0, y0, x1, y1 = (F.lit(v).cast("double") for v in (seen.x0, seen.y0, seen.x1, seen.y1))
    # Beyond the outermost cells there is nothing to count.
    cut = dealt_out(boxes).withColumns({"x0": F.greatest("x0", x0), "y0": F.greatest("y0", y0), "x1": F.least("x1", x1), "y1": F.least("y1", y1)}).where(
        (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    boxed = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    size = F.pow(F.lit(2.0), F.col("_lvl"))
    last = finest + _SQUARE_LEVELS - 1
    at = lambda v: F.floor(col(v) / size)
    inside = lambda s: (F.ceil(F.col("x0") / s), F.ceil(F.col("y0") / s), F.floor(F.col("x1") / s) - 1, F.floor(F.col("y1") / s) - 1)
    sums_of = [F.sum("_n").alias("_n"), F.sum("_valid").alias("_valid")]

    def around(df: DataFrame, outer: Sequence[Column], hole: Sequence[Column]) -> DataFrame:
        """The squares of ``outer`` (first column and row, last column and row) that are not in ``hole``, a row each."""
        span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        named = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(outer)], *[c.alias(f"_h{i}") for i, c in enumerate(hole)])
        o, h = ([F.col(f"_{k}{i}") for i in range(4)] for k in "oh")
        rows = named.withColumn("_by", F.explode(span(o[1], o[3])))
        beside = F.concat(span(o[0], h[0] - 1), span(h[2] + 1, o[2]))
        in_hole = (h[0] <= h[2]) & (F.col("_by") >= h[1]) & (F.col("_by") <= h[3])
        return rows.withColumn("_bx", F.explode(F.when(in_hole, beside).otherwise(span(o[0], o[2])))).select(*map(col, df.columns), "_bx", "_by")

    keys = ["_lvl", "_bx", "_by"]
    fine = placed.withColumn("_lvl", F.lit(finest)).withColumns({"_bx": at("lon"), "_by": at("lat")})
    squares = shared(fine.groupBy("grid_id", *keys).agg(*sums_of), "squares")
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("_lvl") - finest)
    levels = F.explode(F.sequence(F.lit(finest), F.lit(last)))
    sums = squares.withColumn("_lvl", levels).groupBy("grid_id", "_lvl", up("_bx").alias("_bx"), up("_by").alias("_by")).agg(*sums_of)
    # Squares that lie in a larger one that is taken are not.
    larger = [F.when(F.col("_lvl") < last, c * 2 + int(i > 1)).otherwise(F.lit(-int(i > 1)).cast("long")) for i, c in enumerate(inside(size * 2))]
    wanted = around(cut.withColumn("_lvl", levels), inside(size), larger)
    # A few boxes have very many squares; neither side is sent to all tasks for that.
    taken = equi_join(unsent(wanted.select(*map(col, boxed), *keys)), sums, keys, 1 if salts is None else salts)
    sides = around(cut.withColumn("_lvl", F.lit(finest)), (at("x0"), at("y0"), at("x1"), at("y1")), inside(size))
    pairs = equi_join(fine, unsent(sides), keys, salts, dear=True).where(
        (F.col("lon") >= F.col("x0")) & (F.col("lon") <= F.col("x1")) & (F.col("lat") >= F.col("y0")) & (F.col("lat") <= F.col("y1")))
    tested = pairs.groupBy(*map(col, boxed), "grid_id").agg(*sums_of)
    names = [*boxed, "grid_id", "_n", "_valid"]
    return taken.select(*map(col, names)).unionByName(tested.select(*map(col, names)))


def cells_with_coords(cells: DataFrame, transform: Sequence[Column | float]) -> DataFrame:
    """Cell centres from row and column by the affine (a, b, c, d, e, f)."""
    a, b, c, d, e, f = (t if isinstance(t, Column) else F.lit(float(t)) for t in transform)
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    return cells.withColumns({"lon": c + a * x + b * y, "lat": f + d * x + e * y})


def clip_cells(cells: DataFrame, polygons: DataFrame, all_touched: bool = False,
               half: tuple[float, float] | None = None, id_col: str = "polygon_id",
               salts: Salts = SALTS, keep: Sequence[str] | None = None) -> DataFrame:
    """Cells whose centre is in the polygon; with ``all_touched`` every cell it touches.

    ``half`` is half the width and height of a cell in degrees.  ``keep`` names
    the columns of cells to go on with, all by default.
    """
    if not all_touched:
        return match_polygons(cells, polygons, id_col=id_col, salts=salts, keep=keep, bare=True)
    if half is None:
        raise ValueError("all_touched needs the half width and height of a cell")
    return match_polygons(cells, polygons, id_col=id_col, salts=salts, touched_half=half, keep=keep, bare=True)


def cells_near_polygon(cells: DataFrame, polygons: DataFrame, distance: float,
                       id_col: str = "polygon_id", salts: Salts = SALTS, keep: Sequence[str] | None = None) -> DataFrame:
    """Valid cells inside a polygon or within ``distance`` of its boundary, each once; ``keep`` as in :func:`clip_cells`."""
    return within_distance(valid_cells(cells), polygons, distance, id_col=id_col, salts=salts, keep=keep)


def _with_every_polygon(polygons: DataFrame, means: DataFrame, id_col: str) -> DataFrame:
    return polygons.select(col(id_col)).distinct().join(means, id_col, "left")


def zonal_mean(cells: DataFrame, polygons: DataFrame, id_col: str = "polygon_id",
               value: str = "value", salts: Salts = SALTS) -> DataFrame:
    """Mean of the valid cells in each polygon; NULL when there is none."""
    totals = match_totals(valid_cells(cells, value).select("lon", "lat", col(value)), polygons, value, id_col, salts=salts)
    means = totals.groupBy(col(id_col)).agg((F.sum("total") / F.sum("n")).alias("mean_value"), F.sum("n").alias("n_cells"))
    return _with_every_polygon(polygons, means, id_col)


#: What rounding may add to a distance at a radius.
_ROUNDING = 5e-10


def zonal_mean_expanding(cells: DataFrame, polygons: DataFrame, max_distance: float = 0.1,
                         steps: int = 5, id_col: str = "polygon_id", value: str = "value",
                         salts: Salts = SALTS, same: tuple[str, str] | None = None, inside_first: bool = True) -> DataFrame:
    """Mean of the valid cells within the smallest of ``steps`` radii that reaches any.

    From the polygon outwards: the first join looks inside only, which is where
    most polygons find cells and are done.  The rest look around themselves once,
    at the largest radius; a cell's ring is the first radius reaching it, and the
    answer is the ring that comes first, since no smaller one has cells.
    ``same`` names a cell column and a polygon column that must be equal too.
    Where cells are so few that one look around costs less than two joins,
    ``inside_first`` can be switched off; the result is the same.
    """
    usable = valid_cells(cells, value)
    if not inside_first:
        return _with_every_polygon(polygons, _ring_means(usable, polygons, max_distance, max_distance, steps, id_col, value, salts, same), id_col)
    inside = shared(_ring_means(usable, polygons, 0.0, max_distance, steps, id_col, value, salts, same), "means")
    left = polygons.join(inside.select(id_col), id_col, "left_anti")
    if left.isEmpty():
        return _with_every_polygon(polygons, inside, id_col)
    around = _ring_means(usable, left, max_distance, max_distance, steps, id_col, value, salts, same)
    return _with_every_polygon(polygons, inside.unionByName(around), id_col)


def _ring_means(cells: DataFrame, polygons: DataFrame, reach: float, max_distance: float, steps: int, id_col: str, value: str,
                salts: Salts, same: tuple[str, str] | None) -> DataFrame:
    """Of each polygon the mean over the first ring with cells, looking as far as ``reach``."""
    needed = dict.fromkeys(["lon", "lat", value, *([same[0]] if same is not None else [])])
    # Radii are evenly spaced, so the first that reaches the cell follows by division.
    gap = max_distance / max(steps - 1, 1)
    totals = match_totals(cells.select(*map(col, needed)), polygons, value, id_col, reach + _ROUNDING, (_ROUNDING, gap) if gap > 0 else None, salts, same)
    per_ring = (totals.groupBy(col(id_col), F.col("ring").alias("_ring"))
                      .agg((F.sum("total") / F.sum("n")).alias("mean_value"), F.sum("n").alias("n_cells")))
    best = F.min_by(F.struct("mean_value", "n_cells",
                             F.get(radii(max_distance, steps), F.col("_ring")).alias("radius")), F.col("_ring"))
    return per_ring.groupBy(col(id_col)).agg(best.alias("_m")).select(col(id_col), "_m.*")


def spatial_mean_by_time(cells: DataFrame, id_col: str = "polygon_id", ts: str = "ts",
                         value: str = "value") -> DataFrame:
    """Mean over a polygon's cells at each time."""
    return cells.groupBy(col(id_col), col(ts)).agg(F.avg(col(value)).alias("mean_value"))


def grid_iou(cells: DataFrame, first: DataFrame, second: DataFrame, id_col: str = "polygon_id",
             cell_id: str = "cell_id", salts: Salts = SALTS) -> DataFrame:
    """Overlap of two versions of each polygon, measured on cells: both / either; NULL where no cell is in either.

    A cell counts once however often it comes.  Cells that come at one place are
    counted by place, and where they meet the polygons; pairs are made only of
    those that come at several places.
    """
    both = first.select(col(id_col), F.lit(False).alias("_second"), "ring").unionByName(second.select(col(id_col), F.lit(True).alias("_second"), "ring"))
    lon, lat = (F.col(c).cast("double") for c in ("lon", "lat"))
    located = cells.select(col(cell_id).alias("_cell"), lon.alias("lon"), lat.alias("lat")).where(
        lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat))
    spots = located.groupBy("_cell").agg(*[f(c).alias(f"{c}{k}") for c in ("lon", "lat") for k, f in ((0, F.min), (1, F.max))])
    moved = (F.col("lon0") != F.col("lon1")) | (F.col("lat0") != F.col("lat1"))
    spots = shared(spots.select(F.when(moved, F.col("_cell")).alias("_cell"), F.col("lon0").alias("lon"), F.col("lat0").alias("lat"), moved.alias("_moved")), "spots")
    places = spots.where(~F.col("_moved")).groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    counts = match_overlaps(places, both, "_second", id_col, salts)
    several = spots.where("_moved").select("_cell")
    if not several.isEmpty():
        versions = both.select(F.struct(col(id_col).alias("id"), "_second").alias("_v"), "ring")
        hits = match_polygons(lookup(located, several, ["_cell"], how="left_semi", salts=salts), versions, id_col="_v", salts=salts, keep=["_cell"], bare=True)
        per_cell = hits.groupBy(F.col("_v.id").alias(id_col), "_cell").agg(F.bool_or(~F.col("_v._second")).alias("_a"), F.bool_or("_v._second").alias("_b"))
        counts = counts.unionByName(per_cell.select(col(id_col), (F.col("_a") & F.col("_b")).cast("long").alias("both"), F.lit(1).cast("long").alias("either")))
    measured = counts.groupBy(col(id_col)).agg((F.sum("both") / F.sum("either")).alias("iou"))
    every = first.select(col(id_col)).union(second.select(col(id_col))).distinct()
    return every.join(measured, id_col, "left")
