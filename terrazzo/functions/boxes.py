"""Predicates and measures of axis-aligned boxes, space-filling curves and tile boxes, as column expressions.

A box is four columns (or a struct with xmin, ymin, xmax, ymax).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mercator import HALF, tiles_at

EPS = 1e-9  # slack of the inclusive containment test
EXTENT = 4096  # units of a tile's side


@dataclass(frozen=True)
class Box:
    """A box of columns or numbers."""

    xmin: Column | float
    ymin: Column | float
    xmax: Column | float
    ymax: Column | float

    @staticmethod
    def of(struct: str | Column) -> Box:
        s = F.col(struct) if isinstance(struct, str) else struct
        return Box(s["xmin"], s["ymin"], s["xmax"], s["ymax"])

    @staticmethod
    def named(xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> Box:
        return Box(F.col(xmin), F.col(ymin), F.col(xmax), F.col(ymax))

    @staticmethod
    def point(x: str | Column, y: str | Column) -> Box:
        x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
        return Box(x, y, x, y)

    @staticmethod
    def parse(text: str) -> Box:
        """A box of numbers from "xmin,ymin,xmax,ymax"; ValueError unless there are exactly four."""
        parts = [float(p) for p in text.split(",")]
        if len(parts) != 4:
            raise ValueError("a box has four numbers: xmin,ymin,xmax,ymax")
        return Box(*parts)

    def columns(self) -> tuple[Column, Column, Column, Column]:
        return tuple(v if isinstance(v, Column) else F.lit(float(v)) for v in (self.xmin, self.ymin, self.xmax, self.ymax))

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(self.columns(), ("xmin", "ymin", "xmax", "ymax"))))


def intersects(a: Box, b: Box) -> Column:
    """Closed boxes: touching edges intersect."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.columns(), b.columns()
    return (ax1 >= bx0) & (ax0 <= bx1) & (ay1 >= by0) & (ay0 <= by1)


def overlaps(a: Box, b: Box) -> Column:
    """Open boxes: touching edges do not overlap."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.columns(), b.columns()
    return (ax1 > bx0) & (bx1 > ax0) & (ay1 > by0) & (by1 > ay0)


def contains(outer: Box, inner: Box, eps: float = EPS) -> Column:
    (ox0, oy0, ox1, oy1), (ix0, iy0, ix1, iy1) = outer.columns(), inner.columns()
    e = F.lit(eps)
    return (ix0 >= ox0 - e) & (iy0 >= oy0 - e) & (ix1 <= ox1 + e) & (iy1 <= oy1 + e)


def contains_point(box: Box, x: Column, y: Column) -> Column:
    x0, y0, x1, y1 = box.columns()
    return x.between(x0, x1) & y.between(y0, y1)


def is_empty(box: Box) -> Column:
    """Whether a side has no length; a point counts as empty."""
    x0, y0, x1, y1 = box.columns()
    return (x1 <= x0) | (y1 <= y0)


def area(box: Box) -> Column:
    x0, y0, x1, y1 = box.columns()
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def margin(box: Box) -> Column:
    x0, y0, x1, y1 = box.columns()
    return F.greatest(F.lit(0.0), x1 - x0) + F.greatest(F.lit(0.0), y1 - y0)


def merged(a: Box, b: Box) -> Box:
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.columns(), b.columns()
    return Box(F.least(ax0, bx0), F.least(ay0, by0), F.greatest(ax1, bx1), F.greatest(ay1, by1))


def clipped(a: Box, b: Box) -> Box:
    """The intersection; its sides are negative where the boxes are apart."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.columns(), b.columns()
    return Box(F.greatest(ax0, bx0), F.greatest(ay0, by0), F.least(ax1, bx1), F.least(ay1, by1))


def expansion(box: Box, other: Box) -> Column:
    """By how much the box's area grows to take in the other."""
    x0, y0, x1, y1 = box.columns()
    m = merged(box, other)
    return (m.xmax - m.xmin) * (m.ymax - m.ymin) - (x1 - x0) * (y1 - y0)


def scaled(value: Column, low: Column, high: Column, bits: int) -> Column:
    """value in low..high as a whole number of so many bits; 0 where the range has no length."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(high > low, F.floor(share * F.lit(float((1 << bits) - 1)))).otherwise(F.lit(0)).cast("bigint")


def _spread(v: Column) -> Column:
    """Puts a zero bit before each of 32 bits (the usual halving masks)."""
    for shift in (16, 8, 4, 2, 1):
        # the mask keeps runs of `shift` bits and clears as many after each
        mask = sum(((1 << shift) - 1) << (2 * shift * i) for i in range(32 // shift))
        v = F.expr("0L") + v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    """Z-order code of two whole numbers of up to 31 bits, y's bits above x's."""
    x, y = (_spread(v.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))) for v in (x, y))
    return F.shiftleft(y, 1).bitwiseOR(x)


def tile_box(z: int | Column, x: Column, y: Column) -> Box:
    """Mercator box of a tile; rows count from the north."""
    size = F.lit(2 * HALF) / tiles_at(z)
    x0, y1 = F.lit(-HALF) + x * size, F.lit(HALF) - y * size
    return Box(x0, y1 - size, x0 + size, y1)


def in_tile(mx: Column, my: Column, tile: Box, extent: int = EXTENT) -> tuple[Column, Column]:
    """Mercator metres in a tile's units, y upwards."""
    x0, y0, x1, y1 = tile.columns()
    return (mx - x0) / (x1 - x0) * F.lit(float(extent)), (my - y0) / (y1 - y0) * F.lit(float(extent))


def tile_file_name(number: Column, box: Box) -> Column:
    """tile_NNNNNN__xmin_ymin_xmax_ymax.parquet with six decimals and `_` for the point."""
    return F.concat(F.format_string("tile_%06d__", number), F.translate(F.concat_ws("_", *(F.format_string("%.6f", c) for c in box.columns())), ".", "_"), F.lit(".parquet"))


def parsed_file_name(name: Column) -> Box:
    """The box in a tile's file name; nulls where the name has none."""
    part = r"(-?\d+)_(\d{6})"
    pattern = "__" + "_".join([part] * 4)
    get = lambda i: F.when(name.rlike(pattern), F.concat(F.regexp_extract(name, pattern, 2 * i + 1), F.lit("."), F.regexp_extract(name, pattern, 2 * i + 2)).cast("double"))
    return Box(*(get(i) for i in range(4)))
