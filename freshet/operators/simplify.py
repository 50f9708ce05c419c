"""Line simplification, the one place where a ring visits Python.

The walk over a ring is inherently sequential, so an Arrow-batched function
returns the positions to keep; everything else stays in Spark expressions.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.numeric import col, round_coord
from freshet.functions.rings import close_ring

_PAIRS = 1 << 20  # segment pairs tested at a time

# Send these helpers along with the plan, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def keep_lines(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, epsilon: np.ndarray, to_segment: bool = False) -> np.ndarray:
    """Which vertices Ramer-Douglas-Peucker keeps of the open lines ``p[start:end + 1]``, as a mask.

    All lines are walked together: a step takes every chord that may still be
    split, finds the vertex farthest from each, and splits the chords whose
    farthest vertex is more than the line's ``epsilon`` away.
    """
    keep = np.zeros(len(p), bool)
    keep[starts], keep[ends] = True, True
    a, b, eps = starts, ends, epsilon
    while True:
        open_ = b - a > 1
        a, b, eps = a[open_], b[open_], eps[open_]
        if not len(a):
            return keep
        count = b - a - 1
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        chord = np.repeat(np.arange(len(a)), count)
        at = np.arange(count.sum()) - first[chord] + a[chord] + 1
        d, off = (p[b] - p[a])[chord], p[at] - p[a[chord]]
        length_sq = (d * d).sum(axis=1)
        flat = length_sq == 0
        safe = np.where(flat, 1.0, length_sq)
        if to_segment:
            t = np.where(flat, 0.0, np.clip((off * d).sum(axis=1) / safe, 0.0, 1.0))
            away = np.hypot(off[:, 0] - t * d[:, 0], off[:, 1] - t * d[:, 1])
        else:
            away = np.where(flat, 0.0, np.abs(d[:, 0] * off[:, 1] - d[:, 1] * off[:, 0]) / np.sqrt(safe))
        best = np.maximum.reduceat(away, first)
        hits = np.flatnonzero(away == best[chord])
        at_best = at[hits[np.searchsorted(chord[hits], np.arange(len(a)))]]  # the first of equally far ones
        split = best > eps
        at_best = at_best[split]
        keep[at_best] = True
        a, b, eps = np.concatenate([a[split], at_best]), np.concatenate([at_best, b[split]]), np.concatenate([eps[split]] * 2)


def keep_rings(rings: list[np.ndarray], epsilon: np.ndarray, to_segment: bool = False) -> list[np.ndarray]:
    """Positions to keep of closed rings: each split at the vertex farthest from its first, both halves walked as lines."""
    everything = [np.arange(len(p)) for p in rings]
    far = [int(np.hypot(*(p - p[0]).T).argmax()) if len(p) > 4 else 0 for p in rings]
    walked = [k for k, f in enumerate(far) if f]
    if not walked:
        return everything
    p = np.concatenate([rings[k] for k in walked])
    start = np.concatenate([[0], np.cumsum([len(rings[k]) for k in walked])])
    middle = start[:-1] + [far[k] for k in walked]
    eps = np.asarray(epsilon, float)[walked]
    keep = keep_lines(p, np.concatenate([start[:-1], middle]), np.concatenate([middle, start[1:] - 1]), np.concatenate([eps, eps]), to_segment)
    out = list(everything)
    for k, x, y in zip(walked, start, start[1:]):
        kept = np.flatnonzero(keep[x:y])
        if len(kept) < 4:  # both halves went flat: keep the vertex that gives the ring its width
            q = rings[k]
            chord = q[far[k]] - q[0]
            off = np.abs(chord[0] * (q[:, 1] - q[0, 1]) - chord[1] * (q[:, 0] - q[0, 0]))
            kept = everything[k] if off.max() == 0.0 else np.union1d(kept, [int(off.argmax())])
        out[k] = kept
    return out


def self_intersects(p: np.ndarray) -> bool:
    """Do two non-adjacent segments of a closed ring touch?"""
    a, b = p[:-1], p[1:]
    n = len(a)

    def side(o: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.sign((q[..., 0] - o[..., 0]) * (r[..., 1] - o[..., 1])
                       - (q[..., 1] - o[..., 1]) * (r[..., 0] - o[..., 0]))

    def any_touch(i: np.ndarray, j: np.ndarray) -> bool:
        apart = (np.abs(i - j) > 1) & (np.abs(i - j) < n - 1)
        i, j = i[apart], j[apart]
        boxes = np.all((low[i] <= high[j]) & (low[j] <= high[i]), axis=1)
        i, j = i[boxes], j[boxes]
        return bool(np.any((side(a[i], b[i], a[j]) * side(a[i], b[i], b[j]) <= 0)
                           & (side(a[j], b[j], a[i]) * side(a[j], b[j], b[i]) <= 0)))

    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")  # sweep along x
    after = np.searchsorted(low[order, 0], high[order, 0], side="right") - np.arange(n) - 1
    done = 0
    while done < n:  # as many segments as have a bounded number of partners
        stop = max(done + 1, int(np.searchsorted(np.cumsum(after[done:]), _PAIRS)) + done)
        count = after[done:stop]
        left = np.repeat(np.arange(done, min(stop, n)), count)
        right = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + left + 1
        if any_touch(order[left], order[right]):
            return True
        done = stop
    return False


def keep_simple_rings(rings: list[np.ndarray], tolerance: np.ndarray) -> list[np.ndarray]:
    """Like ``keep_rings``, but halves a ring's tolerance until simplifying makes it cross itself nowhere.

    A ring that touches itself to begin with has nothing to protect: it is
    simplified once.
    """
    tolerance = np.array(tolerance, float)
    out = keep_rings(rings, tolerance, to_segment=True)
    open_ = [k for k, p in enumerate(rings) if len(out[k]) < len(p) and self_intersects(p[out[k]]) and not self_intersects(p)]
    while open_:
        tolerance[open_] /= 2
        for k, kept in zip(open_, keep_rings([rings[k] for k in open_], tolerance[open_], to_segment=True)):
            out[k] = kept if tolerance[k] else np.arange(len(rings[k]))
        open_ = [k for k in open_ if len(out[k]) < len(rings[k]) and self_intersects(rings[k][out[k]])]
    return out


def _kept_positions(choose, ring: Column, amount: Column) -> Column:
    @F.pandas_udf("array<int>")
    def positions(lons: pd.Series, lats: pd.Series, amounts: pd.Series) -> pd.Series:
        there = [k for k, x in enumerate(lons) if x is not None]
        rings = [np.column_stack([lons.iloc[k], lats.iloc[k]]).astype(float).reshape(-1, 2) for k in there]
        out: list = [None] * len(lons)
        for k, kept in zip(there, choose(rings, amounts.to_numpy(float)[there])):
            out[k] = kept.astype("int32")
        return pd.Series(out, dtype=object)

    # Not deterministic only in name: it keeps the optimizer from copying the call
    # into filters of its own, which would run the walk twice.
    return positions.asNondeterministic()(ring["lon"], ring["lat"], amount)


def _rdp(lines: list[np.ndarray], epsilon: np.ndarray) -> list[np.ndarray]:
    out = [np.arange(len(p)) for p in lines]
    closed = [k for k, p in enumerate(lines) if len(p) > 2 and np.array_equal(p[0], p[-1])]
    for k, kept in zip(closed, keep_rings([lines[k] for k in closed], epsilon[closed])):
        out[k] = kept
    opened = [k for k, p in enumerate(lines) if len(p) > 2 and not np.array_equal(p[0], p[-1])]
    if opened:
        start = np.concatenate([[0], np.cumsum([len(lines[k]) for k in opened])])
        keep = keep_lines(np.concatenate([lines[k] for k in opened]), start[:-1], start[1:] - 1, epsilon[opened])
        for k, x, y in zip(opened, start, start[1:]):
            out[k] = np.flatnonzero(keep[x:y])
    return out


def _pick(df: DataFrame, ring: str, choose, amount: Column, digits: int | None) -> DataFrame:
    def point(i: Column) -> Column:
        p = F.get(col(ring), i)
        if digits is None:
            return p
        return F.struct(round_coord(p["lon"], digits).alias("lon"), round_coord(p["lat"], digits).alias("lat"))

    kept = df.withColumn("_kept", _kept_positions(choose, col(ring), amount))
    return kept.withColumn(ring, F.transform(F.col("_kept"), point)).drop("_kept")


def simplify_rdp(df: DataFrame, epsilon: float | Column, ring: str = "ring") -> DataFrame:
    """Ramer-Douglas-Peucker on open lines; closed rings are split in two halves first.

    A vertex stays while its distance from the chord's line exceeds ``epsilon``.
    Lines under three points stay as they are.
    """
    amount = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))
    return _pick(df, ring, _rdp, amount, None)


def simplify_rings(df: DataFrame, tolerance: float | Column = 0.005, ring: str = "ring",
                   digits: int = 6) -> DataFrame:
    """Simplify closed rings without letting them cross themselves; rounds coordinates.

    Where the tolerance would make a ring cross itself, a smaller one is taken.
    """
    amount = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    return _pick(df.withColumn(ring, close_ring(col(ring))), ring, keep_simple_rings, amount, digits)
