"""Geometry functions over WKB columns as Arrow-batched UDFs, and their registration for SQL."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from . import wkb

INFO = T.StructType([T.StructField("geom_type", T.StringType()), T.StructField("n_points", T.IntegerType()), T.StructField("is_empty", T.BooleanType()), *(T.StructField(c, T.DoubleType()) for c in ("cx", "cy", "xmin", "ymin", "xmax", "ymax"))])
POINTS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def _decoded(data):
    try:
        return None if data is None else wkb.decode(data)
    except ValueError:
        return None


@pandas_udf(INFO)
def geometry_info(data: pd.Series) -> pd.DataFrame:
    """Type, vertex count, centroid and box; nulls for null or malformed WKB, no box for an empty geometry."""
    rows = []
    for g in map(_decoded, data):
        b = wkb.bounds(g) if g else None
        c = wkb.centroid(g) if b else None
        rows.append((g[0] if g else None, wkb.coordinate_count(g) if g else None, (b is None) if g else None, *(c or (None, None)), *(b or (None,) * 4)))
    return pd.DataFrame(rows, columns=INFO.names).astype({"n_points": "Int32", "is_empty": "boolean"})


@pandas_udf(POINTS)
def vertices(data: pd.Series) -> pd.Series:
    return pd.Series([[{"lon": x, "lat": y} for x, y in wkb.vertices(g).tolist()] if (g := _decoded(d)) else None for d in data])


@pandas_udf(T.BinaryType())
def from_geojson(text: pd.Series) -> pd.Series:
    """WKB of GeoJSON text; null stays null, other text that is no geometry raises."""
    return pd.Series([None if t is None or (g := wkb.from_geojson(json.loads(t))) is None else wkb.encode(g) for t in text])


@pandas_udf(T.StringType())
def to_geojson(data: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(wkb.to_geojson(g)) if (g := _decoded(d)) else None for d in data])


@udtf(returnType=T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))
class TileCover:
    """The tiles at zoom z that a lon/lat box meets."""

    def eval(self, z: int, xmin: float, ymin: float, xmax: float, ymax: float):
        import numpy as np

        from .mercator import HALF
        from .mvt import to_metres

        (x0, y0), (x1, y1) = to_metres(np.array([[xmin, ymin], [xmax, ymax]])).tolist()
        n = 1 << z
        at = lambda t: max(0, min(n - 1, int(np.floor(t * n))))
        for x in range(at((x0 + HALF) / 2 / HALF), at((x1 + HALF) / 2 / HALF) + 1):
            for y in range(at((HALF - y1) / 2 / HALF), at((HALF - y0) / 2 / HALF) + 1):
                yield x, y


def register(spark: SparkSession) -> None:
    """Makes the functions usable from SQL."""
    for name, f in (("tz_geometry_info", geometry_info), ("tz_vertices", vertices), ("tz_from_geojson", from_geojson), ("tz_to_geojson", to_geojson)):
        spark.udf.register(name, f)
    spark.udtf.register("tz_tile_cover", TileCover)


def with_geometry_columns(df, geometry: str = "geometry"):
    """Adds geom_type, n_points, centroid cx and cy, and the box struct bbox of a WKB column."""
    i = F.col("__i")
    return df.withColumn("__i", geometry_info(F.col(geometry))).withColumns({
        "geom_type": i["geom_type"], "n_points": i["n_points"], "cx": i["cx"], "cy": i["cy"],
        "bbox": F.struct(*(i[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax"))),
    }).drop("__i")
