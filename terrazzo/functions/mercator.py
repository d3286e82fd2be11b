"""Web Mercator and tile arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF = 20037508.342789244  # half the extent of EPSG:3857 in metres (fixed)
MAX_LAT = 85.0511287798066  # the latitude whose northing is HALF (fixed)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def mercator_x(lon) -> Column:
    return _col(lon) * F.lit(HALF) / F.lit(180.0)


def mercator_y(lat, clamp: bool = True) -> Column:
    """Northing in metres; by default latitudes beyond the square world are held at its edge."""
    lat = _col(lat)
    if clamp:
        lat = F.greatest(F.least(lat, F.lit(MAX_LAT)), F.lit(-MAX_LAT))
    return F.ln(F.tan((lat + F.lit(90.0)) * F.pi() / F.lit(360.0))) / (F.pi() / F.lit(180.0)) * F.lit(HALF) / F.lit(180.0)


def lon_of(x) -> Column:
    return _col(x) * F.lit(180.0) / F.lit(HALF)


def lat_of(y) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(_col(y) * F.pi() / F.lit(HALF))) - F.pi() / F.lit(2.0))


def tiles_at(z) -> Column:
    """Tiles along one side of the world at zoom z."""
    return F.shiftleft(F.lit(1), z) if isinstance(z, int) else F.pow(F.lit(2.0), _col(z)).cast("int")


def _index(t: Column, z) -> Column:
    n = tiles_at(z)
    return F.greatest(F.lit(0), F.least(n - F.lit(1), F.floor(t * n).cast("int")))


def tile_x(x, z) -> Column:
    """Column of the tile at zoom z that holds the easting x."""
    return _index((_col(x) + F.lit(HALF)) / F.lit(2 * HALF), z)


def tile_y(y, z) -> Column:
    """Row, counted from the north, of the tile at zoom z that holds the northing y."""
    return _index((F.lit(HALF) - _col(y)) / F.lit(2 * HALF), z)
