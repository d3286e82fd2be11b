"""Geometry made from the driver's tables by whole-number arithmetic that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def lon(k: str) -> str:
    return f"(({k})*7919 % 36000)/100.0e0 - 180.0e0 + 0.003e0"


def lat(k: str) -> str:
    return f"(({k})*104729 % 17000)/100.0e0 - 85.0e0 + 0.003e0"


_half_w, _half_h = "(0.05e0 + (s_suppkey % 7)*0.25e0)", "(0.05e0 + (s_suppkey % 5)*0.25e0)"
CUSTOMER = f"SELECT c_custkey, {lon('c_custkey')} AS lon, {lat('c_custkey')} AS lat FROM customer"
EVENT = f"SELECT event_id, {lon('event_id')} AS lon, {lat('event_id')} AS lat, value, event_type FROM events"
SUPPLIER = f"""SELECT s_suppkey,
  greatest({lon('s_suppkey')} - {_half_w}, -179.9e0) AS xmin, greatest({lat('s_suppkey')} - {_half_h}, -85.0e0) AS ymin,
  least({lon('s_suppkey')} + {_half_w}, 179.9e0) AS xmax, least({lat('s_suppkey')} + {_half_h}, 85.0e0) AS ymax FROM supplier"""
MIXED = f"""SELECT c_custkey AS id, 'Point' AS geom_type, 1 AS n_points, lon AS xmin, lat AS ymin, lon AS xmax, lat AS ymax FROM ({CUSTOMER}) c
  UNION ALL SELECT 1000000 + s_suppkey, 'Polygon', 5, xmin, ymin, xmax, ymax FROM ({SUPPLIER}) s
  UNION ALL SELECT 2000000, NULL, NULL, NULL, NULL, NULL, NULL"""

# A partition index with gaps, overlaps and two boxes of equal area.
BOXES = [
    (0, -180.0, -85.0, -60.0, 0.0), (1, -180.0, 5.0, -60.0, 85.0), (2, -50.0, -85.0, 40.0, -10.0), (3, -50.0, -5.0, 40.0, 80.0),
    (4, 30.0, -20.0, 120.0, 20.0), (5, 50.0, 30.0, 140.0, 70.0), (6, 60.0, -80.0, 150.0, -40.0), (7, 150.0, -85.0, 179.0, 85.0), (8, -20.0, 10.0, 10.0, 40.0), (9, -20.0, 10.0, 10.0, 40.0),
]
BOXES_SQL = "(VALUES " + ", ".join(f"({i}, {p}, {a!r}e0, {b!r}e0, {c!r}e0, {d!r}e0)" for i, (p, a, b, c, d) in enumerate(sorted(BOXES, key=lambda x: x[1]))) + ") AS b(idx, pid, xmin, ymin, xmax, ymax)"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view over the tables of sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "events", "supplier") if f"FROM {t}" in sql}
    for name in tables:
        sql = sql.replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(sql, **tables)
