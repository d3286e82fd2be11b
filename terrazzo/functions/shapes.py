"""Simplification and clipping to rectangles.

Clipping is exact for points, lines and rings against an axis-parallel rectangle. Pieces of a ring
that a rectangle cuts apart stay joined along its border, which fills the same area. Rings with
fewer than four points or without area are dropped; a self-crossing ring is clipped as it is.
"""

from __future__ import annotations

import numpy as np

from .wkb import PARTS, Geometry, simple_parts


def simplify_line(points: list, tolerance: float) -> list:
    """Douglas-Peucker with an explicit stack; the ends stay."""
    n = len(points)
    if n < 3 or tolerance <= 0:
        return points
    p = np.array([q[:2] for q in points], float)
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, rest = p[b] - p[a], p[a + 1 : b] - p[a]
        size = np.hypot(*d)
        if size:
            along = np.clip((rest @ d) / size**2, 0, 1)
            off = np.hypot(*(rest - along[:, None] * d).T)
        else:
            off = np.hypot(*rest.T)
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return [q for q, k in zip(points, keep) if k]


def simplify_ring(ring: list, tolerance: float) -> list:
    """A ring simplified by its two halves, or as it was where too little would be left."""
    if len(ring) < 6:
        return ring
    p = np.array([q[:2] for q in ring], float)
    far = int(np.hypot(*(p - p[0]).T).argmax())
    if far in (0, len(ring) - 1):
        return ring
    out = simplify_line(ring[: far + 1], tolerance)[:-1] + simplify_line(ring[far:], tolerance)
    return out if len(out) >= 4 and _area(out) > 0 else ring


def simplify(g: Geometry, tolerance: float) -> Geometry:
    name, c = g
    if name == "GeometryCollection":
        return name, [simplify(x, tolerance) for x in c]
    if name == "LineString":
        return name, simplify_line(c, tolerance)
    if name == "MultiLineString":
        return name, [simplify_line(x, tolerance) for x in c]
    if name == "Polygon":
        return name, [simplify_ring(r, tolerance) for r in c]
    if name == "MultiPolygon":
        return name, [[simplify_ring(r, tolerance) for r in p] for p in c]
    return g


def _area(ring: list) -> float:
    p = np.array([q[:2] for q in ring], float)
    return abs(float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum())) / 2


def clip_line(points: list, box: tuple) -> list[list]:
    """The pieces of a line inside the box, by parameters of each segment (Liang-Barsky)."""
    x0, y0, x1, y1 = box
    out: list[list] = []
    for (ax, ay, *_), (bx, by, *_) in zip(points, points[1:]):
        lo, hi, dx, dy = 0.0, 1.0, bx - ax, by - ay
        inside = True
        for d, q in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
            if d == 0:
                inside &= q >= 0
            elif d < 0:
                lo = max(lo, q / d)
            else:
                hi = min(hi, q / d)
        if not inside or lo > hi or (lo == hi and (dx or dy)):
            continue
        a, b = [ax + lo * dx, ay + lo * dy] if lo else [ax, ay], [ax + hi * dx, ay + hi * dy] if hi < 1 else [bx, by]
        if out and lo == 0 and out[-1][-1] == a:
            out[-1].append(b)
        else:
            out.append([a, b])
    return out


def clip_ring(ring: list, box: tuple) -> list:
    """The part of a closed ring inside the box (Sutherland-Hodgman), or [] if nothing with area is left."""
    points = [list(p[:2]) for p in (ring[:-1] if ring and ring[0] == ring[-1] else ring)]
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for a, b in zip(points[-1:] + points[:-1], points):
            ia, ib = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if ia != ib:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                cross = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cross[axis] = limit
                out.append(cross)
            if ib:
                out.append(b)
        points = out
        if not points:
            return []
    closed = points + [points[0]]
    return closed if len(closed) >= 4 and _area(closed) > 0 else []


def clip(g: Geometry, box: tuple) -> Geometry | None:
    """The geometry inside the box, None if nothing is left."""
    name, c = g
    if name == "GeometryCollection":
        parts = [x for x in (clip(p, box) for p in c) if x]
        return (name, parts) if parts else None
    inside = lambda p: p and box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]
    points, lines, polygons = [], [], []
    for kind, part in simple_parts(g):
        if kind == "Point":
            points += [part] if inside(part) else []
        elif kind == "LineString":
            lines += clip_line(part, box)
        else:
            rings = [clip_ring(r, box) for r in part]
            if rings and rings[0]:
                polygons.append([r for r in rings if r])
    for single, found in (("Point", points), ("LineString", lines), ("Polygon", polygons)):
        if found:
            return (single, found[0]) if len(found) == 1 and name not in PARTS else (f"Multi{single}", found)
    return None
