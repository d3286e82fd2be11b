"""Coordinate reference systems that inputs state: degrees and Web Mercator metres are understood."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions import wkb
from terrazzo.functions.mercator import HALF

from . import files, geojson

DEGREES, METRES = "EPSG:4326", "EPSG:3857"
# Fixed: codes of the two systems.
CODES = {"4326": DEGREES, "CRS84": DEGREES, "4979": DEGREES, "CRS84H": DEGREES, "3857": METRES, "900913": METRES, "3785": METRES, "102100": METRES}


def known(crs: str | dict | None) -> str:
    """EPSG:4326 or EPSG:3857 for a name, URN or PROJJSON; no CRS means degrees; ValueError for others."""
    if isinstance(crs, str) and crs.lstrip().startswith("{"):
        crs = json.loads(crs)
    if isinstance(crs, dict):
        code = str((crs.get("id") or {}).get("code", ""))
    else:
        code = re.split(r"[:/]", crs.strip())[-1].upper() if crs else "4326"
    if code not in CODES:
        raise ValueError(f"coordinates in {crs!r} are not understood: give EPSG:4326 or EPSG:3857")
    return CODES[code]


def footer_crs(path: str, geometry: str = "geometry") -> str | dict | None:
    """The CRS in the GeoParquet footer of a file, or of a folder's first file."""
    if files.kind(path) == "folder":
        found = [i.path for i in files.listing(path, deep=True) if i.path.endswith(".parquet") and i.is_file]
        if not found:
            return None
        where, _ = files.store(path)
        source = found[0]
    else:
        where, source = files.store(path)
    with where.open_input_file(source) as f:
        geo = (pq.read_metadata(f).metadata or {}).get(b"geo")
    columns = json.loads(geo).get("columns", {}) if geo else {}
    return (columns.get(geometry) or {}).get("crs")


def source_crs(spark: SparkSession, path: str, geometry: str = "geometry") -> str:
    """The system of an input's coordinates, from its GeoJSON header or GeoParquet footer."""
    return known(geojson.crs_hint(geojson.head(spark, path)) if geojson.is_geojson(path) else footer_crs(path, geometry))


def _degrees(p: np.ndarray) -> np.ndarray:
    return np.stack([p[:, 0] * 180 / HALF, np.degrees(2 * np.arctan(np.exp(p[:, 1] * np.pi / HALF)) - np.pi / 2)], 1)


def in_degrees(geometry: Column, crs: str) -> Column:
    """WKB in degrees from WKB in a known system."""
    if crs == DEGREES:
        return geometry
    @F.pandas_udf("binary")
    def convert(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else wkb.encode(wkb.mapped(wkb.decode(d), _degrees)) for d in data])

    return convert(geometry)
