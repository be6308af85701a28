"""Polygons: shrinking to a share of the area, and pixel masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chords of a quarter circle, which stands for the arc around a corner that points inwards.
QUARTER = 16


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def _opened(ring: np.ndarray) -> np.ndarray:
    """Anticlockwise, without the closing point and repeated points."""
    ring = np.asarray(ring, float)
    ring = ring[np.any(ring != np.roll(ring, 1, axis=0), axis=1)]
    x, y = ring[:, 0], ring[:, 1]
    return ring if len(ring) < 3 or np.dot(x, np.roll(y, -1)) >= np.dot(y, np.roll(x, -1)) else ring[::-1]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _offsets(ring: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the segments that can bound what is ``d`` away from an anticlockwise ring: its sides moved in, in
    order, then around each corner that points inwards the chords of a circle of radius ``d``; and the chords' centres."""
    sides = np.roll(ring, -1, 0) - ring
    normals = np.stack([-sides[:, 1], sides[:, 0]], 1) / np.hypot(sides[:, 0], sides[:, 1])[:, None]
    starts, ends, centres = [ring + d * normals], [np.roll(ring, -1, 0) + d * normals], [np.empty((0, 2))]
    for i in range(len(ring)):
        one, two = normals[i - 1], normals[i]
        turn = float(np.arctan2(_cross(one, two), one @ two))
        if turn < -1e-12 or one @ two < -1 + 1e-12:  # a corner inwards, or a spike
            turn = -abs(turn)
            angles = np.arctan2(one[1], one[0]) + np.linspace(0, turn, int(np.ceil(-turn / (np.pi / 2) * QUARTER - 1e-9)) + 1)
            points = ring[i] + d * np.stack([np.cos(angles), np.sin(angles)], 1)
            points[0], points[-1] = ring[i] + d * one, ring[i] + d * two
            starts.append(points[:-1])
            ends.append(points[1:])
            centres.append(np.repeat(ring[i : i + 1], len(points) - 1, 0))
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(centres)


def _near(ring: np.ndarray, d: float, starts: np.ndarray, ends: np.ndarray, centres: np.ndarray, points: np.ndarray, slack: float) -> np.ndarray:
    """Which points lie, by more than ``slack``, in the strip of a side or the triangle of a chord: nearer than ``d``."""
    n = len(ring)
    sides = np.roll(ring, -1, 0) - ring
    length = np.hypot(sides[:, 0], sides[:, 1])
    off = points[:, None] - ring[None]
    along, deep = (off * (sides / length[:, None])).sum(2), -_cross(off, (sides / length[:, None])[None])
    hit = ((along > -slack) & (along < length + slack) & (deep > -slack) & (deep < d - slack)).any(1)
    if len(centres):
        a, b = starts[n:] - centres, ends[n:] - centres
        off = points[:, None] - centres[None]
        chord = b - a
        deep = _cross(chord[None], off - a[None]) / np.hypot(chord[:, 0], chord[:, 1])
        hit |= ((_cross(a[None], off) < slack * d) & (_cross(off, b[None]) < slack * d) & (deep < -slack)).any(1)
    return hit


def _split(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments cut where they cross each other."""
    way = ends - starts
    gap = starts[None, :] - starts[:, None]
    below = _cross(way[:, None], way[None, :])
    with np.errstate(invalid="ignore", divide="ignore"):
        t, u = _cross(gap, way[None, :]) / below, _cross(gap, way[:, None]) / below
    hit = (below != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
    crossed = hit.any(1)
    first, last = [starts[~crossed]], [ends[~crossed]]
    for i in np.flatnonzero(crossed):
        at = np.unique(np.concatenate([[0.0], t[i, hit[i]], [1.0]]))
        points = starts[i] + at[:, None] * way[i]
        points[-1] = ends[i]
        first.append(points[:-1])
        last.append(points[1:])
    return np.concatenate(first), np.concatenate(last)


def _inset(ring: np.ndarray, d: float) -> np.ndarray:
    """The largest piece of what lies in an anticlockwise ring at least ``d`` away from it, as a ring (empty if none).

    Segments that can bound it are cut where they cross; those whose middle isn't nearer do, and what follows one of them
    begins where it ends.
    """
    if d <= 0:
        return ring
    size = float(np.ptp(ring, 0).max())
    starts, ends, centres = _offsets(ring, d)
    a, b = _split(starts, ends)
    middle = (a + b) / 2
    keep = np.hypot(*(b - a).T) > 1e-9 * size
    keep[keep] = inside(ring, *middle[keep].T) & ~_near(ring, d, starts, ends, centres, middle[keep], 1e-10 * size)
    a, b = a[keep], b[keep]
    best, most = np.empty((0, 2)), 0.0
    if not len(a):
        return best
    reach = np.hypot(a[None, :, 0] - b[:, None, 0], a[None, :, 1] - b[:, None, 1])
    np.fill_diagonal(reach, np.inf)
    after, seen = reach.argmin(1), np.zeros(len(a), bool)
    open_ = reach[np.arange(len(a)), after] > 1e-6 * size  # nothing follows
    for start in range(len(a)):
        path = []
        at = start
        while not seen[at]:
            seen[at] = True
            path.append(at)
            at = int(after[at])
        if at in path and not open_[path].any():
            points = a[path[path.index(at) :]]
            x, y = points.T
            own = float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
            if own > most:
                best, most = points, own
    return best


def inside(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    hit = np.zeros(x.shape, bool)
    for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, 0), strict=True):
        if y0 != y1:
            hit ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return hit


def shrink(ring: list | np.ndarray, percent: float) -> list[list[float]] | None:
    """The ring moved inwards until ``percent`` % of its area is left; the largest piece if it splits; null if none is.

    Sides move in as they are, around corners that point inwards goes a circle of QUARTER chords a quarter. Where the
    largest piece loses a part at once, at a neck, so that no distance gives the area, the last ring before is taken.
    """
    points = _opened(np.asarray([list(p) for p in ring], float).reshape(-1, 2)) if len(ring) else np.empty((0, 2))
    if len(points) < 3 or area(points) <= 0:
        return None
    whole = area(points)
    target, size = whole * percent / 100, float(np.ptp(points, 0).max())
    low, high, over, under, piece = 0.0, float(np.ptp(points, 0).min()), whole - target, -target, points
    for step in range(90):
        # The border's length says how fast area is lost; beyond what is known to be too far, between both by the areas, and
        # every third time the middle, in case that one end stays.
        middle = low + over / float(np.hypot(*(np.roll(piece, -1, 0) - piece).T).sum())
        if middle >= high or step % 3 == 2:
            middle = (low + high) / 2 if step % 3 == 2 else low + (high - low) * over / (over - under)
        found = _inset(points, middle)
        gap = (area(found) if len(found) >= 3 else 0.0) - target
        if gap > -1e-10 * target:
            low, over, piece = middle, max(gap, 0.0), found
        else:
            high, under = middle, gap
        if abs(gap) < 1e-9 * target or high - low < 1e-13 * size:
            break
    return [*piece.tolist(), piece[0].tolist()] if low > 0 else None


def fill(ring: list | np.ndarray, height: int, width: int) -> np.ndarray:
    """Flat indices of the pixels in a ring, its border included; coordinates are cut to whole pixels first."""
    points = np.asarray([list(p) for p in ring], float).reshape(-1, 2).astype(np.int32).astype(int)
    mask = np.zeros((height, width), bool)
    ends = np.roll(points, -1, 0)
    for y in range(max(0, points[:, 1].min()), min(height - 1, points[:, 1].max()) + 1):
        cross = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in zip(points, ends, strict=True) if (y0 <= y) != (y1 <= y))
        for a, b in zip(cross[::2], cross[1::2], strict=False):
            lo, hi = max(0, int(np.ceil(a))), min(width - 1, int(np.floor(b)))
            mask[y, lo : hi + 1] = True
    for (x0, y0), (x1, y1) in zip(points, ends, strict=True):
        n = max(abs(x1 - x0), abs(y1 - y0)) + 1
        xs, ys = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
        ok = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        mask[ys[ok], xs[ok]] = True
    return np.flatnonzero(mask)


def shrunk_ring(ring: Column, percent: int) -> Column:
    @F.pandas_udf("array<array<double>>")
    def run(rings: pd.Series) -> pd.Series:
        made: dict[tuple, list | None] = {}  # equal rings of a batch are shrunk once

        def one(r: object) -> list | None:
            key = tuple(float(x) for p in r for x in p)
            if key not in made:
                made[key] = shrink(r, percent)
            return made[key]

        return rings.map(lambda r: None if r is None else one(r))

    return run(ring)


def mask_pixels(ring: Column, height: Column, width: Column) -> Column:
    """Flat indices of the pixels in a ring, as :func:`fill` gives them; null for no ring. Equal rings of a batch are filled once."""

    @F.pandas_udf("array<int>")
    def run(rings: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        made: dict[tuple, np.ndarray] = {}

        def one(r: object, a: int, b: int) -> np.ndarray:
            points = np.array([p for p in r], float)
            key = (points.tobytes(), a, b)
            if key not in made:
                made[key] = fill(points, a, b).astype(np.int32)
            return made[key]

        return pd.Series([None if r is None else one(r, int(a), int(b)) for r, a, b in zip(rings, h, w, strict=True)])

    return run(ring, height, width)
