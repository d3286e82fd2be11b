"""R*-style partitioning of a bounded driver sample into boxes of about equal counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Options:
    fill: float = 0.95  # least share of a partition's capacity on either side of a split
    band: float = 0.0  # middle share of the valid splits to look at; 0 means all
    to_infinity: bool = False  # stretch outer boxes over the plane


def _scores(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a split after each point of a sorted slice: margin sum, overlap, area sum."""
    low, high = np.minimum.accumulate(p, 0)[:-1], np.maximum.accumulate(p, 0)[:-1]
    low2, high2 = np.minimum.accumulate(p[::-1], 0)[::-1][1:], np.maximum.accumulate(p[::-1], 0)[::-1][1:]
    a, b = high - low, high2 - low2
    between = np.maximum(0.0, np.minimum(high, high2) - np.maximum(low, low2))
    return a.sum(1) + b.sum(1), between.prod(1), a.prod(1) + b.prod(1)


def _split(p: np.ndarray, w: np.ndarray, least: float, band: float) -> tuple[np.ndarray, int]:
    """An order of the points and the size of the left part.

    On each axis, splits that leave `least` weight on both sides compete by margin, then overlap,
    then area; the first axis and the first split win ties. Without any, the middle is taken.
    """
    n, best = len(p), None
    for axis in range(p.shape[1]):
        order = np.argsort(p[:, axis], kind="stable")
        left = np.cumsum(w[order])[:-1]
        valid = np.flatnonzero((left >= least) & (w.sum() - left >= least))
        if band > 0 and len(valid):
            lo, hi = int((1 - band) * 0.5 * len(valid)), int((1 + band) * 0.5 * len(valid))
            valid = valid[lo:hi] if hi > lo else valid
        if not len(valid):
            valid = np.array([min(n // 2, n - 2)])
        m, o, a = _scores(p[order])
        k = valid[np.lexsort((valid, a[valid], o[valid], m[valid]))[0]]
        score = (m[k], o[k], a[k])
        if best is None or score < best[0]:
            best = (score, order, int(k) + 1)
    return best[1], best[2]


def partition_points(points: np.ndarray, parts: int, weights: np.ndarray | None = None, options: Options = Options()) -> list[tuple[int, float, float, float, float]]:
    """Boxes (pid, xmin, ymin, xmax, ymax), each the tight box of its share of the points.

    No box holds more than the capacity, the ceiling of the total over the number of parts; there
    may be a few more boxes than parts, and gaps between them.
    """
    if not len(points):
        raise ValueError("no points to partition")
    w = np.ones(len(points)) if weights is None else np.asarray(weights, float)
    most = math.ceil(w.sum() / parts)
    least = math.ceil(options.fill * most) if weights is None else options.fill * w.sum() / parts
    out, stack = [], [np.arange(len(points))]
    while stack:
        mine = stack.pop()
        if w[mine].sum() <= most or len(mine) < 2:
            p = points[mine]
            out.append((len(out), *p.min(0).tolist(), *p.max(0).tolist()))
            continue
        order, k = _split(points[mine], w[mine], least, options.band)
        stack += [mine[order[k:]], mine[order[:k]]]
    return stretched(out) if options.to_infinity else out


def stretched(boxes):
    """Boxes at the outer border reach to infinity."""
    a, b, c, d = (f(x[i] for x in boxes) for f, i in ((min, 1), (min, 2), (max, 3), (max, 4)))
    inf = math.inf
    return [(p, -inf if x0 == a else x0, -inf if y0 == b else y0, inf if x1 == c else x1, inf if y1 == d else y1) for p, x0, y0, x1, y1 in boxes]


def partition_count(num_tiles: int | None, total_bytes: int, partition_size: int) -> int:
    """num_tiles if given, else the bytes over the partition size, at least 1."""
    return num_tiles or max(1, math.ceil(total_bytes / partition_size))
