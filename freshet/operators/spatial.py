"""Points, grid cells and boxes against polygons, as bucket equi-joins.

Every polygon gets a bucket size (a power of two, in degrees) that suits its
extent and its number of vertices, so it covers a bounded number of buckets
whether it is a pond or a continent.  Per bucket it keeps the few edges that
pass through, and whether the bucket's anchor point is inside.  A point then
needs an equality join on its bucket and a walk over those few edges: it is
inside if the way from the anchor to the point crosses an odd number of them.

Where an outline is dense, buckets are quartered until each keeps a set number
of edges, so a coast of a million vertices costs a point no more than a square.

The buckets are written to shared storage once.  Points look into one bucket per
size in use; only buckets that hold very many points are split.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from freshet.functions.numeric import col
from freshet.functions.rings import close_ring, edge_meets_box, ring_bbox, ring_edges
from freshet.functions.text import leading_letters
from freshet.operators import walk
from freshet.operators.filters import not_after
from freshet.operators.joins import SALTS, Salts, dealt_out, equi_join, lookup, met_by_key, unsent
from freshet.operators.staging import shared

_MIN_LEVEL, _MAX_LEVEL = -20, 8
# Where in a bucket its anchor sits: off every round fraction, so that real
# coordinates do not line up with it.
_AX, _AY = math.sqrt(2) - 1, math.sqrt(3) - 1
#: Of buckets up to this size, by count of their edges, the keys are broadcast.
BROADCAST_BYTES = 64 << 20
_EDGE_BYTES, _ROW_BYTES = 32, 256
#: Edges that a bucket keeps, unless they meet in a point.
MAX_EDGES = 64
HUC_LEVELS = (4, 6, 8)
_BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
_EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _level(extent: Column, least: float = 0.0) -> Column:
    """Smallest power of two that is at least ``extent``, as its exponent."""
    e = F.greatest(extent, F.lit(max(least, 2.0 ** _MIN_LEVEL)))
    return F.least(F.ceil(F.log2(e)), F.lit(_MAX_LEVEL)).cast("int")


def _bucket(v: Column, size: Column) -> Column:
    return F.floor(v / size)


def _polygon_level(ring: Column, margin: float) -> Column:
    """Bucket size for 4 to 64 buckets across, more for more vertices; denser places are split later."""
    box = ring_bbox(ring)
    extent = F.greatest(box["max_lon"] - box["min_lon"], box["max_lat"] - box["min_lat"]) + 2 * margin
    across = F.greatest(F.lit(4.0), F.least(F.lit(64.0), F.size(ring) / 64.0))
    return _level(extent / across, margin)


def _levels_in_use(df: DataFrame) -> Column:
    """The distinct bucket sizes as one array: at most 29 numbers."""
    return df.select("_lvl").distinct().agg(F.collect_list("_lvl")).scalar()


def gathered_polygons(polygons: DataFrame, id_col: str, ring_col: str, margin: float, attrs: Sequence[str] = (),
                      same: str | None = None, second: str | None = None) -> DataFrame:
    """(id, _parts, _lvl, _dense, _box, _a, _same, _firsts): a row for each polygon with its different rings.

    Landed polygons repeat and may have several rings under one id.  All parts of
    a polygon get the bucket size of the one that needs the largest.  ``second``
    names a column that marks rings of a second version of their polygon: these
    come after the ``_firsts`` rings of the first.
    """
    rings_of = lambda second: F.collect_set(F.when(second, col(ring_col)))
    one = polygons.where(col(ring_col).isNotNull()).groupBy(col(id_col)).agg(
        (F.concat(rings_of(~col(second)), rings_of(col(second))) if second else F.collect_set(col(ring_col))).alias("_parts"),
        (F.size(rings_of(~col(second))) if second else F.lit(0)).alias("_firsts"),
        (F.min(F.struct(*map(col, attrs))) if attrs else F.lit(None).cast("int")).alias("_a"),
        (F.collect_set(col(same)) if same else F.array(F.lit(0))).alias("_same"))
    boxes = F.transform("_parts", ring_bbox)
    box = F.struct(*[f(F.col("_b")[c]).alias(c) for c, f in zip(_BOX, (F.array_min, F.array_min, F.array_max, F.array_max))])
    vertices = F.aggregate("_parts", F.lit(0), lambda n, r: n + F.size(r) + 1)
    return (one.withColumn("_lvl", F.array_max(F.transform("_parts", lambda r: _polygon_level(r, margin))))
               .withColumn("_dense", vertices > MAX_EDGES).withColumn("_b", boxes).withColumn("_box", box).drop("_b"))


_KEY = ("_lvl", "_bx", "_by")


def _edge(e: Column) -> Column:
    """An edge with what tests against it need, worked out once."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    return F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2"),
                    dx.alias("dx"), dy.alias("dy"), F.coalesce(F.try_divide(dx, dy), F.lit(0.0)).alias("slope"),
                    F.coalesce(F.try_divide(F.lit(1.0), dx * dx + dy * dy), F.lit(0.0)).alias("per_length_sq"))


def _distance_sq(e: Column, x: Column, y: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * e["dx"] + (y - e["y1"]) * e["dy"]) * e["per_length_sq"]))
    return F.pow(x - e["x1"] - t * e["dx"], 2) + F.pow(y - e["y1"] - t * e["dy"], 2)


def _meets_bucket(e: Column, slack: float) -> Column:
    s = _size(F.col("_lvl"))
    return edge_meets_box(e, F.col("_bx") * s, F.col("_by") * s, (F.col("_bx") + 1) * s, (F.col("_by") + 1) * s, slack=slack + s * 1e-9)


def edge_buckets(parts: DataFrame, id_col: str, margin: float) -> tuple[DataFrame, DataFrame]:
    """(edges, anchors) of polygon parts at their own bucket size.

    ``edges`` has a row (id, _part, _lvl, _bx, _by, _e) for every bucket that an
    edge passes through, ``margin`` widening what counts; ``anchors`` a row
    without ``_e`` for every bucket whose anchor is inside the part.
    """
    rows = (parts.select(col(id_col), "_part", "_lvl", F.explode(ring_edges(close_ring(F.col("_ring")))).alias("e"))
                 .select(col(id_col), "_part", "_lvl", _edge(F.col("e")).alias("_e")).withColumn("_s", _size(F.col("_lvl"))))
    e, s = F.col("_e"), F.col("_s")

    def span(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(_bucket(F.least(a, b) - margin, s), _bucket(F.greatest(a, b) + margin, s)))

    edges = (rows.withColumn("_bx", span(e["x1"], e["x2"])).withColumn("_by", span(e["y1"], e["y2"]))
                 .where(_meets_bucket(e, margin)).select(col(id_col), "_part", *_KEY, "_e"))

    # Anchors of a bucket row: the part's edges cut the row's anchor line at some
    # columns, and the anchors between an odd and an even cut are inside.
    line = (F.col("_by") + F.lit(_AY)) * s
    cut_x = e["x1"] + (line - e["y1"]) * F.try_divide(e["dx"], e["dy"])
    cuts = (rows.withColumn("_by", F.explode(F.sequence(
                    _bucket(F.least(e["y1"], e["y2"]), s) - 1, _bucket(F.greatest(e["y1"], e["y2"]), s))))
                .where((e["y1"] > line) != (e["y2"] > line))
                .select(col(id_col), "_part", "_lvl", "_by", (F.ceil(cut_x / s - F.lit(_AX)) - 1).alias("_last")))
    row = W.partitionBy(col(id_col), "_part", "_by").orderBy("_last")
    runs = (cuts.withColumn("_to_right", F.count(F.lit(1)).over(row.rowsBetween(W.currentRow, W.unboundedFollowing)))
                .withColumn("_prev", F.lag("_last").over(row))
                .where((F.col("_to_right") % 2 == 1) & (F.col("_last") > F.col("_prev"))))
    anchors = runs.select(col(id_col), "_part", "_lvl", F.explode(F.sequence(F.col("_prev") + 1, F.col("_last"))).alias("_bx"), "_by")
    return edges, anchors


def quartered(edges: DataFrame, anchors: DataFrame, id_col: str, margin: float, nearest: bool,
              most: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """The same area in buckets of ``most`` edges at most: those with more are quartered twice, round after round.

    An edge goes to the quarters it passes through.  A quarter's anchor is inside
    if the way to it from the old anchor, up or down and then across, crosses an
    odd number of edges, counting the old anchor's side.  Within a margin, if
    only the nearest edge matters (``nearest``), a quarter also drops edges that
    another is nearer than from all of it.  Buckets end at the smallest size, within
    a margin at an eighth of it, or at the margin where every edge within it
    matters: smaller ones would be many and hold hardly less.  Only what is still
    too dense is written and read again in a round; nothing is gathered by bucket.
    """
    key = [id_col, *_KEY]
    lowest = _MIN_LEVEL if margin <= 0 else max(_MIN_LEVEL, math.ceil(math.log2(margin / 8 if nearest else margin)))
    edges, anchors = shared(edges, "edges"), shared(anchors, "anchors")
    done: list[tuple[DataFrame, DataFrame]] = []
    while True:
        dense = edges.groupBy(*map(col, key)).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > most) & (F.col("_lvl") >= lowest + 2))
        dense = shared(dense.select(*map(col, key)), "dense")
        if dense.isEmpty():
            done.append((edges, anchors))
            return tuple(_union([d[i] for d in done]) for i in (0, 1))
        done.append((edges.join(dense, key, "left_anti"), anchors.join(dense, key, "left_anti")))
        pieces = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(4) for y in range(4)]))

        def quarters(rows: DataFrame) -> DataFrame:
            return (rows.join(dense, key, "left_semi").withColumn("_q", pieces)
                        .withColumns({"_px": F.col("_bx"), "_py": F.col("_by"), "_lvl": F.col("_lvl") - 2})
                        .withColumns({"_bx": F.col("_bx") * 4 + F.col("_q.x"), "_by": F.col("_by") * 4 + F.col("_q.y")}))

        s, e = _size(F.col("_lvl")), F.col("_e")
        ax, ay = (F.col("_px") + F.lit(_AX)) * 4 * s, (F.col("_py") + F.lit(_AY)) * 4 * s
        bx, by = (F.col("_bx") + F.lit(_AX)) * s, (F.col("_by") + F.lit(_AY)) * s
        up_at = e["y1"] + (ax - e["x1"]) * F.try_divide(e["dy"], e["dx"])
        across_at = e["x1"] + (by - e["y1"]) * e["slope"]
        up = ((e["x1"] > ax) != (e["x2"] > ax)) & ((up_at > ay) != (up_at > by))
        across = ((e["y1"] > by) != (e["y2"] > by)) & ((across_at > ax) != (across_at > bx))
        split = quarters(edges)
        crossings = split.withColumn("_c", F.coalesce(up.cast("int"), F.lit(0)) + F.coalesce(across.cast("int"), F.lit(0))).where("_c > 0")
        sides = crossings.select(*map(col, key), "_part", "_c").unionByName(quarters(anchors).select(*map(col, key), "_part", F.lit(1).alias("_c")))
        anchors = sides.groupBy(*map(col, key), "_part").agg(F.sum("_c").alias("_c")).where("_c % 2 = 1").drop("_c")
        kept = split.where(_meets_bucket(e, margin))
        if nearest and margin > 0:
            half = s * (math.sqrt(2) / 2)
            far = kept.withColumn("_d", F.sqrt(_distance_sq(e, (F.col("_bx") + 0.5) * s, (F.col("_by") + 0.5) * s)))
            least = far.groupBy(*map(col, key)).agg(F.min("_d").alias("_least"))
            kept = far.join(least, key).where(_meets_bucket(e, 0.0) | (F.col("_d") - half <= F.col("_least") + half * (1 + 1e-9)))
        edges = shared(kept.select(col(id_col), "_part", *_KEY, "_e"), "edges")
        anchors = shared(anchors.select(col(id_col), "_part", *_KEY), "anchors")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _flat(rings: Column) -> Column:
    """Rings (_anchor_in, _edges, _ups, _whole, _part) as one array of numbers that ``walk.Pieces`` reads.

    Of each: 1 if the anchor is inside, plus 2 if it is there as a whole, plus 4 times its number among the polygon's
    rings; how many edges and ups; the edges; the ups.
    What goes to Python is weighed row by row, field by field, so nested fields cost far more than their numbers.
    """
    def numbers(r: Column) -> Column:
        edges, ups = F.coalesce(r["_edges"], F.array().cast(_EDGES)), F.coalesce(r["_ups"], F.array().cast("array<double>"))
        head = F.array(*[c.cast("double") for c in (r["_anchor_in"].cast("int") + 2 * r["_whole"].cast("int") + 4 * r["_part"], F.size(edges), F.size(ups))])
        return F.concat(head, F.flatten(F.transform(edges, lambda e: F.array(*[e[c] for c in ("x1", "y1", "x2", "y2")]))), ups)
    return F.flatten(F.transform(rings, numbers))


def whole_buckets(small: DataFrame, id_col: str, margin: float, facts: Sequence[str] = ()) -> DataFrame:
    """(id, _lvl, _bx, _by, _shape) of polygons with few edges, and their ``facts``: every bucket of their box has them all."""
    s, box = _size(F.col("_lvl")), F.col("_box")
    ring = lambda r, i: F.struct(F.lit(False).alias("_anchor_in"), ring_edges(close_ring(r)).cast(_EDGES).alias("_edges"),
                              F.array().cast("array<double>").alias("_ups"), F.lit(True).alias("_whole"), i.alias("_part"))
    return (small.withColumn("_shape", _flat(F.transform("_parts", ring)))
                 .withColumn("_bx", F.explode(F.sequence(_bucket(box["min_lon"] - margin, s), _bucket(box["max_lon"] + margin, s))))
                 .withColumn("_by", F.explode(F.sequence(_bucket(box["min_lat"] - margin, s), _bucket(box["max_lat"] + margin, s))))
                 .select(col(id_col), *_KEY, "_shape", *facts))


def ring_buckets(dense: DataFrame, id_col: str = "polygon_id", margin: float = 0.0, nearest: bool = True) -> DataFrame:
    """(id, _lvl, _bx, _by, _rings) for every bucket a polygon needs, from :func:`gathered_polygons`.

    ``_rings`` has an entry (_anchor_in, _edges, _ups, _whole, _part) for every part that reaches
    the bucket.  ``_edges`` are the edges passing through, ``_ups`` the heights at
    which edges cross the vertical through the anchor.
    """
    parts = dense.select(col(id_col), "_lvl", F.posexplode("_parts").alias("_part", "_ring"))
    edges, anchors = quartered(*edge_buckets(parts, id_col, margin), id_col, margin, nearest)
    e = F.col("_e")
    anchor_x = (F.col("_bx") + F.lit(_AX)) * _size(F.col("_lvl"))
    up = F.when((e["x1"] > anchor_x) != (e["x2"] > anchor_x), e["y1"] + (anchor_x - e["x1"]) * F.try_divide(e["dy"], e["dx"]))
    through = edges.groupBy(col(id_col), "_part", *_KEY).agg(F.collect_list(F.struct(*[e[c].alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("_edges"), F.collect_list(up).alias("_ups"))
    ring = F.struct(F.coalesce("_anchor_in", F.lit(False)).alias("_anchor_in"),
                    F.coalesce("_edges", F.array().cast(_EDGES)).alias("_edges"),
                    F.coalesce("_ups", F.array().cast("array<double>")).alias("_ups"), F.lit(False).alias("_whole"), "_part")
    inside = anchors.withColumn("_anchor_in", F.lit(True))
    return (through.join(inside, [id_col, "_part", *_KEY], "full")
                   .groupBy(col(id_col), *_KEY).agg(F.collect_list(ring).alias("_rings")))


def _in_buckets(points: DataFrame, x: str, y: str, levels: Column) -> DataFrame:
    size = _size(F.col("_lvl"))
    return (points.withColumn("_lvl", F.explode(levels))
                  .withColumns({"_bx": _bucket(col(x), size), "_by": _bucket(col(y), size)}))


def _met(points: DataFrame, polygons: DataFrame, x: str, y: str, id_col: str, ring_col: str, attrs: Sequence[str], reach: float,
         salts: Salts, same: tuple[str, str] | None, first: bool, nearest: bool, carried: Sequence[Column],
         second: str | None = None) -> tuple[DataFrame, list[str]]:
    """(rows, keys): pieces of polygons and points by bucket for :mod:`walk`, points with the columns ``carried`` as ``_pt``."""
    held = shared(gathered_polygons(polygons, id_col, ring_col, reach, attrs, None if same is None else same[1], second), "polygons")
    facts = ["_box", *(["_a"] if attrs else []), *(["_same"] if same else []), *(["_firsts"] if second else [])]
    # Pieces take a polygon's facts along: by the size of the few rows they are made of, a join would send all pieces to every task.
    kept = whole_buckets(held.where("NOT _dense"), id_col, reach, facts)
    across = [F.floor((F.col(f"_box.max_{c}") + reach) / _size(F.col("_lvl"))) - F.floor((F.col(f"_box.min_{c}") - reach) / _size(F.col("_lvl"))) + 1
              for c in ("lon", "lat")]
    edges = F.aggregate("_parts", F.lit(0), lambda n, r: n + F.size(r) + 1)
    seen = held.agg(F.collect_set("_lvl").alias("levels"), F.max("_dense").alias("dense"),
                    F.sum(F.when(~F.col("_dense"), across[0] * across[1] * (edges * _EDGE_BYTES + _ROW_BYTES))).alias("size")).first()
    levels, size = set(seen.levels), seen.size or 0  # at most 29 levels
    if seen.dense:
        split = shared(ring_buckets(held.where("_dense"), id_col, reach, nearest).select(col(id_col), *_KEY, _flat(F.col("_rings")).alias("_shape")), "buckets")
        more = split.agg(F.collect_set("_lvl").alias("levels"), F.sum(F.size("_shape") * 8 + _ROW_BYTES).alias("size")).first()
        levels, size = levels | set(more.levels), size + (more.size or 0)
        kept = kept.unionByName(split.join(held.where("_dense").select(col(id_col), *facts), id_col))
    keys = [*_KEY]
    if attrs:
        kept = kept.select(*[c for c in kept.columns if c != "_a"], "_a.*")
    if same is not None:
        keys.append("_same")
        kept = kept.withColumn("_same", F.explode("_same")).where(F.col("_same").isNotNull())
    shape = F.concat(F.array(*[F.col("_box")[c] for c in _BOX]), "_shape")
    kept = kept.select(*keys, F.struct(col(id_col), *map(col, attrs), *(["_firsts"] if second else []), shape.alias("_shape")).alias("_piece"))
    located = [col(c).cast("double") for c in (x, y)]
    there = located[0].isNotNull() & located[1].isNotNull() & ~F.isnan(located[0]) & ~F.isnan(located[1])
    placed = points.where(there).select(F.struct(*carried).alias("_pt"), located[0].alias("_x"), located[1].alias("_y"),
                                        *([col(same[0]).alias("_same")] if same is not None else []))
    if same is not None:
        placed = placed.where(F.col("_same").isNotNull())
    placed = _in_buckets(placed, "_x", "_y", F.array(*map(F.lit, sorted(levels))).cast("array<int>"))
    if size <= BROADCAST_BYTES:  # points far from every polygon stay where they are
        placed = placed.join(F.broadcast(kept.select(*keys).distinct()), keys, "left_semi")
    placed, kept, keys, tasks = met_by_key(placed, kept, keys, salts)
    kinds = placed.select(*keys, "_x", "_y", "_pt", F.lit(None).cast(kept.schema["_piece"].dataType).alias("_piece")).unionByName(
        kept.withColumns({"_x": F.lit(None).cast("double"), "_y": F.lit(None).cast("double"),
                          "_pt": F.lit(None).cast(placed.schema["_pt"].dataType)}))
    # Rows are sorted by one number, which costs far less than by all keys: a bucket's hash, its last bit set for points,
    # so that pieces come first; with ``first`` in the order of their ids.  Buckets of one hash are told apart in the walk.
    of_bucket = F.xxhash64(*map(F.col, keys)).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.col("_piece").isNull().cast("long"))
    sorted_in = [F.col("_at"), *([F.col("_piece")[id_col]] if first else [])]
    return kinds.withColumn("_at", of_bucket).repartition(tasks, *map(F.col, keys)).sortWithinPartitions(*sorted_in), keys


def match_polygons(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat",
                   id_col: str = "polygon_id", ring_col: str = "ring",
                   attrs: Sequence[str] = (), margin: float = 0.0, salts: Salts = SALTS,
                   touched_half: tuple[float, float] | None = None,
                   same: tuple[str, str] | None = None, first: bool = False, keep: Sequence[str] | None = None, bare: bool = False) -> DataFrame:
    """Every (point, polygon) pair that the polygon contains; adds ``inside`` (strictly), unless ``bare``.

    Rows of ``polygons`` with one id are parts of one polygon, and repeated rows
    count once.  A polygon contains a point when any part does, and is as far
    away as its nearest part; a pair comes out once however many parts it meets.
    Of differing ``attrs`` of one id the smallest are taken.

    With ``margin`` also pairs within that distance of the boundary, and
    ``away_sq``, the squared distance from the polygon: 0 inside (not if ``bare``).  With
    ``touched_half``, half the width and height of a cell, instead also pairs
    whose cell an edge crosses.  ``same`` names a point column and a polygon
    column that must be equal too; they become part of the join key.  With
    ``first`` a point need not come out with every polygon that holds it, but does
    with the one of the smallest id.  ``keep`` names the point columns that pairs
    have, all by default; pairs are many.

    Writes the polygons to shared storage, dense ones by bucket, and reads them
    for the join, so their side is worked out once and its size is known.  Points
    and pieces of polygons meet by bucket, and are tested there as arrays (``walk``).
    """
    reach = max(touched_half) if touched_half is not None else margin
    met, keys = _met(points, polygons, x, y, id_col, ring_col, attrs, reach, salts, same, first, touched_half is None,
                     [col(c) for c in (points.columns if keep is None else keep)])
    measure = margin if touched_half is None else 0.0
    of_piece = [id_col, *attrs]
    fields = [*met.schema["_pt"].dataType.fields, *(met.schema["_piece"].dataType[c] for c in of_piece),
              *([] if bare else [T.StructField("inside", T.BooleanType())]), *([T.StructField("away_sq", T.DoubleType())] if measure > 0 and not bare else [])]
    walked = lambda batches: walk.pairs(batches, keys, of_piece, (_AX, _AY), reach, measure, touched_half, first, bare)
    return met.mapInArrow(walked, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def match_totals(cells: DataFrame, polygons: DataFrame, value: str, id_col: str = "polygon_id", margin: float = 0.0,
                 rings: tuple[float, float] | None = None, salts: Salts = SALTS, same: tuple[str, str] | None = None) -> DataFrame:
    """(id, ring, total, n): sums of the cells that :func:`match_polygons` pairs with a polygon, in several rows per polygon.

    The pairs are not made: a task sends on the sums of a polygon over a batch of
    a bucket's cells.  ``rings`` is (rounding, gap): a cell at distance d counts in
    ring ``ceil((d - rounding) / gap)``, at least 0; without it all do in ring 0.
    """
    met, keys = _met(cells, polygons, "lon", "lat", id_col, "ring", (), margin, salts, same, False, True, [col(value).cast("double").alias("value")])
    walked = lambda batches: walk.totals(batches, keys, id_col, (_AX, _AY), margin, rings)
    return met.mapInArrow(walked, T.StructType([T.StructField(id_col, polygons.schema[id_col].dataType), T.StructField("ring", T.IntegerType()),
                                                T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())]))


def match_overlaps(points: DataFrame, polygons: DataFrame, second: str, id_col: str = "polygon_id", salts: Salts = SALTS) -> DataFrame:
    """(id, both, either): points in both versions of a polygon and in any of them, in several rows per polygon.

    A row of ``points`` stands for ``n`` of them.  ``second`` names the column of ``polygons`` that marks rings of the second
    version.  Both versions are laid out as one polygon, so they meet a point in
    one bucket, and the pairs are not made.
    """
    met, keys = _met(points, polygons, "lon", "lat", id_col, "ring", (), 0.0, salts, None, False, True, [F.col("n").cast("long").alias("n")], second)
    walked = lambda batches: walk.overlaps(batches, keys, id_col, (_AX, _AY))
    return met.mapInArrow(walked, T.StructType([T.StructField(id_col, polygons.schema[id_col].dataType), T.StructField("both", T.LongType()), T.StructField("either", T.LongType())]))


def points_in_polygons(points: DataFrame, polygons: DataFrame, **kw) -> DataFrame:
    """Pairs where the point is strictly inside; boundary points belong to no polygon."""
    return match_polygons(points, polygons, bare=True, **kw)


def within_distance(points: DataFrame, polygons: DataFrame, distance: float, **kw) -> DataFrame:
    """Pairs where the point is inside, or at most ``distance`` (degrees) from the boundary."""
    return match_polygons(points, polygons, margin=distance, bare=True, **kw)


def assign_watershed(points: DataFrame, polygons: DataFrame, point_id: str = "point_id",
                     level: int | None = None, order: str | None = None, x: str = "lon",
                     y: str = "lat", salts: Salts = SALTS) -> DataFrame:
    """The first polygon that strictly contains each point; points without one get no row.

    "First" goes by ``order`` (a column of ``polygons``), by id without one.
    Watersheds without a name or a code are no match.
    """
    if level is not None:
        polygons = polygons.where(F.col("huc_level") == level)
    named = polygons.where(F.col("name").isNotNull() & F.col("huc_id").isNotNull() & F.col("ring").isNotNull())
    order = order or "huc_id"
    attrs = list(dict.fromkeys(["huc_id", "name", order]))
    keyed = named.select(F.struct(col(order).alias("order"), F.col("huc_id").alias("id")).alias("_p"), "ring", *map(col, attrs))
    # Polygons are numbered in their order, so that of a point's many polygons the first is the least of numbers.
    numbered = shared(keyed.groupBy("_p").agg(F.min(F.struct(*map(col, attrs))).alias("_a")).orderBy("_p")
                           .withColumn("_no", F.monotonically_increasing_id()), "numbered")
    rings = lookup(keyed.select("_p", "ring"), numbered.select("_p", "_no"), ["_p"], how="inner", salts=1).drop("_p")
    pairs = match_polygons(points.select(col(point_id), col(x), col(y)), rings, x, y, id_col="_no", salts=salts, first=True)
    first = pairs.groupBy(col(point_id)).agg(F.min_by(col(x), F.col("_no")).alias(x), F.min_by(col(y), F.col("_no")).alias(y),
                                             F.min("_no").alias("_first"))
    names = numbered.select(F.col("_no").alias("_first"), F.col("_a.huc_id").alias("huc_id"), F.col("_a.name").alias("name"))
    return lookup(first, names, ["_first"], how="inner", salts=1).select(col(point_id), col(x), col(y), "huc_id", "name")


def huc_code(level: Column, huc2: Column, code: Column, name: Column) -> Column:
    """A watershed's id: level 4 is named by its region and first two letters."""
    return F.when(level == 4, F.concat(F.coalesce(huc2, F.lit("")), leading_letters(name))).otherwise(
        F.coalesce(code, F.lit("Unknown")))


def huc_for_points(points: DataFrame, polygons: DataFrame, level: int, **kw) -> DataFrame:
    """Each point's watershed at level 4, 6 or 8."""
    if level not in HUC_LEVELS:
        raise ValueError(f"no watersheds of level {level}; there are {HUC_LEVELS}")
    return assign_watershed(points, polygons, level=level, **kw)


def polygon_bbox(polygons: DataFrame, id_col: str = "polygon_id", ring_col: str = "ring") -> DataFrame:
    return polygons.select(col(id_col), ring_bbox(col(ring_col)).alias("b")).select(col(id_col), "b.*")


def points_in_boxes(points: DataFrame, boxes: DataFrame, id_col: str = "polygon_id", x: str = "lon",
                    y: str = "lat", margin: float = 0.0, salts: Salts = SALTS) -> DataFrame:
    """(point, box) pairs with the point in the closed box grown by ``margin``; keeps the box columns."""
    min_x, min_y, max_x, max_y = (col(c) for c in _BOX)
    extent = F.greatest(max_x - min_x, max_y - min_y) + 2 * margin
    sized = boxes.select(col(id_col), *_BOX, _level(extent / 4).alias("_lvl"))
    s = _size(F.col("_lvl"))
    spread = (sized.withColumn("_bx", F.explode(F.sequence(_bucket(min_x - margin, s), _bucket(max_x + margin, s))))
                   .withColumn("_by", F.explode(F.sequence(_bucket(min_y - margin, s), _bucket(max_y + margin, s)))))
    pairs = equi_join(_in_buckets(points, x, y, _levels_in_use(sized)), spread, _KEY, salts)
    inside = ((col(x) >= min_x - margin) & (col(x) <= max_x + margin)
              & (col(y) >= min_y - margin) & (col(y) <= max_y + margin))
    return pairs.where(inside).drop("_lvl", "_bx", "_by")


#: Ranges of up to four days are laid out alike.
_LEAST_SPAN = 2


def granules_for_requests(requests: DataFrame, granules: DataFrame, request_id: str = "request_id",
                          salts: Salts = SALTS) -> DataFrame:
    """Granules that overlap each request's box and date range.

    Requests and granules carry ``start``, ``end`` and the four box columns.
    Dates and timestamps both work, on one side or both, and the ranges are
    compared exactly; an ``end`` that is a date includes its whole day.  Both
    sides are put in classes of space and of whole days, each of a power of two
    that suits the own extent.  For each class of requests a granule lies in one
    cell, where its box and its range begin; a request takes the cells in which
    a granule of a class may begin to overlap it, which are a bounded number since
    the cells suit the coarser of both.  So a pair meets in one place and comes out
    once, and what is copied most is requests, a set number of times.  Neither
    side is sent to all tasks, however small the tables are that it is made of.
    """
    def measured(df: DataFrame, tag: str) -> DataFrame:
        there = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in _BOX]
        kept = (df.where(not_after(df, F.col("start"), F.col("end")) & there[0] & there[1] & there[2] & there[3])
                  .select(*[col(c).alias(f"{tag}{c}") for c in df.columns]))
        days = F.col(f"{tag}until") - F.col(f"{tag}from") + 1
        return (kept.withColumns({f"{tag}from": _day(F.col(f"{tag}start")), f"{tag}until": _day(F.col(f"{tag}end"))})
                    .withColumns({f"{tag}lvl": _level(F.greatest(F.col(f"{tag}max_lon") - F.col(f"{tag}min_lon"), F.col(f"{tag}max_lat") - F.col(f"{tag}min_lat"))),
                                  f"{tag}span": F.greatest(F.ceil(F.log2(days.cast("double"))).cast("int"), F.lit(_LEAST_SPAN))}))

    def _day(t: Column) -> Column:
        return F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date"))

    def _in_span(day: Column) -> Column:
        return F.call_function("shiftright", day, F.col("_span"))

    asked, there = measured(requests, "r_"), measured(granules, "g_")
    # Classes are few: 29 sizes and 22 spans at most.
    of_requests = asked.select("r_lvl", "r_span").distinct().collect()
    x, y, day = F.col("g_min_lon"), F.col("g_min_lat"), F.col("g_from")
    of_granules = there.groupBy("g_lvl", "g_span").agg(
        F.max(F.col("g_max_lon") - x).alias("_w"), F.max(F.col("g_max_lat") - y).alias("_h"), F.max(F.col("g_until") - day).alias("_d"),
        *[f(v).cast("double").alias(f"{n}{k}") for n, v in (("_x", x), ("_y", y)) for k, f in ((0, F.min), (1, F.max))], F.min(day).alias("_t0"), F.max(day).alias("_t1")).collect()
    # Cells are half as wide as the coarser box, and as long as a quarter of the coarser range.
    met = [(r.r_lvl, r.r_span, *g, max(r.r_lvl, g.g_lvl) - 1, max(r.r_span, g.g_span) - _LEAST_SPAN) for r in of_requests for g in of_granules]
    meetings = requests.sparkSession.createDataFrame(met, """r_lvl int, r_span int, _wide int, _long int, _w double, _h double, _d int,
        _x0 double, _x1 double, _y0 double, _y1 double, _t0 int, _t1 int, _lvl int, _span int""")
    cells = meetings.select(F.col("_wide").alias("g_lvl"), F.col("_long").alias("g_span"), "_lvl", "_span").distinct()
    s = _size(F.col("_lvl"))
    keys = ["_lvl", "_wide", "_bx", "_by", "_span", "_long", "_day"]
    left = there.join(F.broadcast(cells), ["g_lvl", "g_span"]).withColumnsRenamed({"g_lvl": "_wide", "g_span": "_long"}).withColumns(
        {"_bx": _bucket(x, s), "_by": _bucket(y, s), "_day": _in_span(day)})

    def span(low: Column, high: Column) -> Column:
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    def begin(axis: str, extent: str) -> Column:
        low, least, most = F.col(f"r_min_{axis}"), *[F.col(f"_{'x' if axis == 'lon' else 'y'}{k}") for k in (0, 1)]
        # Rounding may bring a granule's beginning a little nearer than its extent.
        slack = s * 1e-9 + (F.abs(low) + F.abs(extent)) * 1e-12
        return span(_bucket(F.greatest(low - F.col(extent) - slack, least), s), _bucket(F.least(F.col(f"r_max_{axis}"), most), s))

    right = (dealt_out(asked).join(F.broadcast(meetings), ["r_lvl", "r_span"])
                  .withColumn("_day", span(_in_span(F.greatest(F.col("r_from") - F.col("_d"), F.col("_t0"))), _in_span(F.least(F.col("r_until"), F.col("_t1")))))
                  .withColumn("_bx", begin("lon", "_w")).withColumn("_by", begin("lat", "_h"))
                  .select(*keys, *[f"r_{c}" for c in requests.columns]))
    left, right, keys, tasks = met_by_key(left.select(*keys, *[f"g_{c}" for c in granules.columns]), right, keys, salts)  # one cell may hold most of either side
    # Rows are sorted by one number first, which costs far less than by all keys.
    at = F.xxhash64(*map(F.col, keys))
    left, right = (df.withColumn("_at", at).repartition(tasks, "_at", *keys) for df in (left, right))
    joined = unsent(left).join(right, ["_at", *keys])
    pairs = joined.where(
        not_after(joined, F.col("r_start"), F.col("g_end")) & not_after(joined, F.col("g_start"), F.col("r_end"))
        & (F.col("r_min_lon") <= F.col("g_max_lon")) & (F.col("g_min_lon") <= F.col("r_max_lon"))
        & (F.col("r_min_lat") <= F.col("g_max_lat")) & (F.col("g_min_lat") <= F.col("r_max_lat")))
    return pairs.select(F.col(f"r_{request_id}").alias(request_id),
                        *[F.col(f"g_{c}").alias(c) for c in granules.columns])
