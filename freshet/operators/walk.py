"""The test of a bucket's points against its polygons: whole arrays at a time, on Arrow batches.

``spatial`` brings points and polygon pieces together by bucket; a task gets a
bucket's pieces first and then its points, in batches, and keeps nothing but the
pieces of the bucket at hand.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

_TESTED = 1 << 17  # edges times points looked at in one go
_PAIRS = 1 << 16  # pairs sent on at once
_TOTALS = 1 << 13  # sums sent on at once, at the end of a batch

# Send these helpers along with the plan, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


class Pieces:
    """Polygon pieces of a batch: a piece has a box and rings, a ring has edges and ups, all in one array (``spatial._flat``)."""

    def __init__(self, rows: pa.StructArray, carried: Sequence[str]):
        self.carried = pa.StructArray.from_arrays([rows.field(c) for c in carried], list(carried))
        shapes = rows.field("_shape")
        self.at, self.values = _numbers(shapes.offsets), _numbers(shapes.values)
        self.box = [self.values[self.at[:-1] + i] for i in range(4)]
        self.read: dict[int, list[tuple[bool, bool, np.ndarray, np.ndarray, int]]] = {}

    def rings(self, piece: int) -> list[tuple[bool, bool, np.ndarray, np.ndarray, int]]:
        """(anchor inside, there as a whole, edges with what tests need, ups, number) of each ring."""
        found = self.read.get(piece)
        if found is None:
            found = self.read[piece] = []
            i, stop = int(self.at[piece]) + 4, self.at[piece + 1]
            while i < stop:
                kind, n, ups = (int(v) for v in self.values[i:i + 3])
                i += 3
                e = np.empty((8, n, 1))
                e[:4, :, 0] = self.values[i:i + 4 * n].reshape(n, 4).T
                e[4:6] = e[2:4] - e[:2]
                dx, dy = e[4], e[5]
                length_sq = dx * dx + dy * dy
                e[6:] = 0.0
                np.divide(dx, dy, out=e[6], where=dy != 0)
                np.divide(1.0, length_sq, out=e[7], where=length_sq != 0)
                i += 4 * n
                found.append((kind % 2 == 1, kind // 2 % 2 == 1, e, self.values[i:i + ups, None], kind // 4))
                i += ups
        return found


def _by_parts(test, edges: np.ndarray, x: np.ndarray, y: np.ndarray, kind) -> np.ndarray:
    """``test`` over so many points at a time that its tables stay small."""
    step = max(1, _TESTED // max(1, edges.shape[1]))
    if len(x) <= step:
        return test(edges, x, y)
    out = np.empty(len(x), kind)
    for i in range(0, len(x), step):
        out[i:i + step] = test(edges, x[i:i + step], y[i:i + step])
    return out


def _on_edge(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2, dx, dy, _, _ = edges
    on_line = dx * (y - y1) == (x - x1) * dy
    if not on_line.any():  # the rule
        return on_line.any(axis=0)
    return (on_line & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2))
            & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))).any(axis=0)


def inside(pieces: Pieces, piece: int, anchor: tuple[float, float], x: np.ndarray, y: np.ndarray, numbers: range | None = None) -> np.ndarray:
    """Which points are strictly inside any ring, or any of these ``numbers``.

    The way from the anchor goes straight up or down to the point's height, then
    across; edges it crosses flip the anchor's side.  A ring that is there as a
    whole has its anchor far to the right.
    """
    out = np.zeros(len(x), bool)
    for anchor_in, whole, edges, ups, number in pieces.rings(piece):
        if numbers is not None and number not in numbers:
            continue
        if not edges.shape[1]:
            out |= anchor_in
            continue
        from_x = np.inf if whole else anchor[0]

        def odd(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            at = e[0] + (y - e[1]) * e[6]
            return np.bitwise_xor.reduce(((e[1] > y) != (e[3] > y)) & ((at > x) != (at > from_x)), axis=0)

        side = _by_parts(odd, edges, x, y, bool) ^ bool(anchor_in)
        if len(ups):
            side ^= np.bitwise_xor.reduce((ups > anchor[1]) != (ups > y), axis=0)
        held = np.flatnonzero(side)
        out[held] |= ~_by_parts(_on_edge, edges, x[held], y[held], bool)
    return out


def edge_sq(pieces: Pieces, piece: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of every point from the nearest edge; infinite without edges."""
    def nearest(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        t = np.maximum(0.0, np.minimum(1.0, ((x - e[0]) * e[4] + (y - e[1]) * e[5]) * e[7]))
        return (np.square(x - e[0] - t * e[4]) + np.square(y - e[1] - t * e[5])).min(axis=0)

    out = np.full(len(x), np.inf)
    for _, _, edges, _, _ in pieces.rings(piece):
        if edges.shape[1]:
            out = np.fmin(out, _by_parts(nearest, edges, x, y, float))
    return out


def touched(pieces: Pieces, piece: int, half: tuple[float, float], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points have a cell of ``half`` its width and height that an edge touches."""
    def meets(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x1, y1, x2, y2 = e[:4]
        left, low, right, high = x - half[0], y - half[1], x + half[0], y + half[1]
        nx, ny = y2 - y1, x1 - x2
        to_centre = nx * ((left + right) / 2 - x1) + ny * ((low + high) / 2 - y1)
        reach = np.abs(nx) * ((right - left) / 2) + np.abs(ny) * ((high - low) / 2)
        return ((np.minimum(x1, x2) <= right) & (np.maximum(x1, x2) >= left) & (np.minimum(y1, y2) <= high)
                & (np.maximum(y1, y2) >= low) & (np.abs(to_centre) <= reach)).any(axis=0)

    out = np.zeros(len(x), bool)
    for _, _, edges, _, _ in pieces.rings(piece):
        if edges.shape[1]:
            out |= _by_parts(meets, edges, x, y, bool)
    return out


def bucket_pairs(held: Sequence[tuple[Pieces, int, int]], anchor: tuple[float, float], x: np.ndarray, y: np.ndarray,
                 reach: float, margin: float, half: tuple[float, float] | None, first: bool) -> Iterator[tuple]:
    """(pieces, piece, points, inside, squared distance) for each of a bucket's pieces that holds any of the points.

    Points must be sorted by their y.  With ``first`` a point is looked for in no
    further piece once one holds it.
    """
    xs, ys = x, y
    open_ = np.ones(len(xs), bool)
    for pieces, start, stop in held:
        min_x, min_y, max_x, max_y = pieces.box
        low = np.searchsorted(ys, min_y[start:stop] - reach, "left")
        high = np.searchsorted(ys, max_y[start:stop] + reach, "right")
        for k in np.flatnonzero(low < high):
            piece, a, b = start + int(k), low[k], high[k]
            near = (xs[a:b] >= min_x[piece] - reach) & (xs[a:b] <= max_x[piece] + reach)
            if first:
                near &= open_[a:b]
            at = np.flatnonzero(near) + a
            if not len(at):
                continue
            px, py = xs[at], ys[at]
            if reach > 0:  # outside the polygon's own box there is nothing to walk
                hit = (px >= min_x[piece]) & (px <= max_x[piece]) & (py >= min_y[piece]) & (py <= max_y[piece])
                boxed = np.flatnonzero(hit)
                hit[boxed] = inside(pieces, piece, anchor, px[boxed], py[boxed])
            else:
                hit = inside(pieces, piece, anchor, px, py)
            away = None
            take = hit
            if half is not None:
                take = hit.copy()
                out = np.flatnonzero(~hit)
                take[out] = touched(pieces, piece, half, px[out], py[out])
            elif margin > 0:
                away = np.zeros(len(px))
                out = np.flatnonzero(~hit)
                away[out] = edge_sq(pieces, piece, px[out], py[out])
                take = away <= margin ** 2
            if not take.any():
                continue
            if first:
                open_[at[take]] = False
                if not open_.any():
                    yield pieces, piece, at[take], hit[take], None if away is None else away[take]
                    return
            yield pieces, piece, at[take], hit[take], None if away is None else away[take]


class Places:
    """A bucket's points by place, sorted by y: cells of one place, as at many times, are tested as one."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.order = np.lexsort((x, y))
        xs, ys = x[self.order], y[self.order]
        new = np.concatenate([[True], (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])])
        self.starts = np.flatnonzero(new)
        self.counts = np.diff(np.append(self.starts, len(xs)))
        self.x, self.y = xs[self.starts], ys[self.starts]

    def points(self, places: np.ndarray) -> np.ndarray:
        """The points of some places, place after place."""
        counts = self.counts[places]
        first = np.cumsum(counts) - counts
        return self.order[np.arange(counts.sum()) + np.repeat(self.starts[places] - first, counts)]


def _buckets(batches: Iterator[pa.RecordBatch], keys: Sequence[str], carried: Sequence[str], at: tuple[float, float],
             reach: float, margin: float, half: tuple[float, float] | None, first: bool) -> Iterator[tuple]:
    """(batch, pieces found) for every bucket in batches sorted by ``_at``: a hash of the keys, of each hash the pieces first.

    The pieces found are (offset of the bucket's points, places, anchor, one of :func:`bucket_pairs`) in turn; after
    the last bucket of a batch comes (batch, None).
    """
    last, held = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        hashed = _numbers(batch.column("_at")) >> 1
        columns = [batch.column(k) for k in keys]
        differs = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            differs |= _numbers(pc.not_equal(c[1:], c[:-1]))
        bounds = [0, *(np.flatnonzero(differs) + 1), batch.num_rows]
        rows = batch.column("_piece")
        is_piece = _numbers(rows.is_valid())
        before = np.concatenate([[0], np.cumsum(is_piece)])
        pieces = Pieces(rows.filter(rows.is_valid()), carried) if is_piece.any() else None
        x, y = (_numbers(batch.column(c)) for c in ("_x", "_y"))
        level, bx, by = (_numbers(batch.column(c)) for c in ("_lvl", "_bx", "_by"))
        for s, e in zip(bounds, bounds[1:]):
            if hashed[s] != last:
                last, held = hashed[s], {}
            key = tuple(c[int(s)].as_py() for c in columns)
            middle = s + before[e] - before[s]  # pieces come before points
            if middle > s:
                held.setdefault(key, []).append((pieces, int(before[s]), int(before[e])))
            if middle == e or key not in held:
                continue
            size = 2.0 ** level[s]
            anchor = ((bx[s] + at[0]) * size, (by[s] + at[1]) * size)
            places = Places(x[middle:e], y[middle:e])
            yield batch, (middle, places, anchor, bucket_pairs(held[key], anchor, places.x, places.y, reach, margin, half, first))
        yield batch, None


def pairs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], carried: Sequence[str], at: tuple[float, float], reach: float,
          margin: float, half: tuple[float, float] | None, first: bool, bare: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of matching (point, polygon) rows from batches of points and pieces (:func:`_buckets`).

    ``bare`` rows don't say whether the point is inside nor how far away.
    """
    distances = margin > 0 and half is None and not bare
    out: list[tuple] = []
    waiting = 0
    for batch, bucket in _buckets(batches, keys, carried, at, reach, margin, half, first):
        if bucket is not None:
            middle, places, _, found = bucket
            for pieces, piece, index, hit, away in found:
                counts = places.counts[index]
                out.append((places.points(index) + middle, pieces, piece, None if bare else np.repeat(hit, counts), np.repeat(away, counts) if distances else None))
                waiting += len(out[-1][0])
                if waiting >= _PAIRS:
                    yield _sent(batch.column("_pt"), out, distances)
                    out, waiting = [], 0
        elif out:
            yield _sent(batch.column("_pt"), out, distances)
            out, waiting = [], 0


def totals(batches: Iterator[pa.RecordBatch], keys: Sequence[str], id_col: str, at: tuple[float, float], margin: float,
           rings: tuple[float, float] | None) -> Iterator[pa.RecordBatch]:
    """Batches of (id, ring, total, n) from the same batches: the sums of a polygon over a bucket's points, not the pairs."""
    out: list[tuple] = []
    waiting, values, of = 0, None, None
    for batch, bucket in _buckets(batches, keys, [id_col], at, margin, margin, None, False):
        if bucket is not None:
            if of is not batch:
                values, of = _numbers(batch.column("_pt").field("value")), batch
            middle, places, _, found = bucket
            sums = np.add.reduceat(values[middle:middle + len(places.order)][places.order], places.starts)
            for pieces, piece, index, hit, away in found:
                if rings is None or hit.all():
                    ring, total, n = np.zeros(1, np.int64), sums[index].sum(keepdims=True), places.counts[index].sum(keepdims=True)
                else:
                    of_place = np.maximum(0, np.ceil((np.sqrt(away) - rings[0]) / rings[1])).astype(np.int64)
                    n = np.bincount(of_place, places.counts[index])
                    ring = np.flatnonzero(n)
                    total, n = np.bincount(of_place, sums[index])[ring], n[ring]
                out.append((pieces, piece, ring, total, n))
                waiting += len(ring)
        elif waiting >= _TOTALS:
            yield _summed(out)
            out, waiting = [], 0
    if out:
        yield _summed(out)


def overlaps(batches: Iterator[pa.RecordBatch], keys: Sequence[str], id_col: str, at: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, points in both, points in either) for polygons of two versions: rings under ``_firsts`` are the first's.

    A row counts as ``n`` points.
    """
    out: list[tuple] = []
    of, n = None, None
    for batch, bucket in _buckets(batches, keys, [id_col, "_firsts"], at, 0.0, 0.0, None, False):
        if bucket is not None:
            if of is not batch:
                n, of = _numbers(batch.column("_pt").field("n")), batch
            middle, places, anchor, found = bucket
            held = np.add.reduceat(n[middle:middle + len(places.order)][places.order], places.starts)
            for pieces, piece, index, _, _ in found:
                firsts, counts = pieces.carried.field("_firsts")[piece].as_py(), held[index]
                both = np.ones(len(index), bool)
                for numbers in (range(firsts), range(firsts, 1 << 40)):
                    both &= inside(pieces, piece, anchor, places.x[index], places.y[index], numbers)
                out.append((pieces, piece, np.array([counts[both].sum()]), np.array([counts.sum()])))
        elif len(out) >= _TOTALS:
            yield _counted(out)
            out = []
    if out:
        yield _counted(out)


def _counted(out: Sequence[tuple]) -> pa.RecordBatch:
    ids = _taken([o[:2] for o in out], [1] * len(out)).field(0)
    return pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in (2, 3)]], [f"c{i}" for i in range(3)])


def _summed(out: Sequence[tuple]) -> pa.RecordBatch:
    ids = _taken([o[:2] for o in out], [len(o[2]) for o in out]).field(0)
    ring, total, n = (np.concatenate([o[k] for o in out]) for k in (2, 3, 4))
    return pa.RecordBatch.from_arrays([ids, pa.array(ring.astype(np.int32)), pa.array(total), pa.array(n.astype(np.int64))], [f"c{i}" for i in range(4)])


def _taken(found: Sequence[tuple[Pieces, int]], times: Sequence[int]) -> pa.StructArray:
    """What each piece carries, so many times."""
    by_batch: dict[int, tuple[Pieces, list[int], list[int]]] = {}
    for n, (pieces, piece) in enumerate(found):
        _, where, which = by_batch.setdefault(id(pieces), (pieces, [], []))
        where.append(n)
        which.append(piece)
    polygons = pa.concat_arrays([p.carried.take(pa.array(which)) for p, _, which in by_batch.values()])
    row_of = np.empty(len(found), np.int64)
    row_of[np.concatenate([where for _, where, _ in by_batch.values()])] = np.arange(len(found))
    return polygons.take(pa.array(np.repeat(row_of, times)))


def _sent(points: pa.StructArray, out: Sequence[tuple], distances: bool) -> pa.RecordBatch:
    index = np.concatenate([o[0] for o in out])
    polygon = _taken([o[1:3] for o in out], [len(o[0]) for o in out])
    columns = [*points.take(pa.array(index)).flatten(), *polygon.flatten()]
    if out[0][3] is not None:
        columns.append(pa.array(np.concatenate([o[3] for o in out])))
    if distances:
        columns.append(pa.array(np.concatenate([o[4] for o in out])))
    return pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
