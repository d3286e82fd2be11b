"""Queries by name over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.functions.boxes import Box, clipped, contains, contains_point, in_tile, intersects, morton, overlaps, parsed_file_name, scaled, tile_box, tile_file_name
from terrazzo.functions.mercator import HALF, MAX_LAT, lat_of, lon_of, mercator_x, mercator_y, tile_x, tile_y
from terrazzo.operators import assign, sampling, stats, tiles

from .views import BOXES, BOXES_SQL, CUSTOMER, EVENT, MIXED, SUPPLIER, view

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


customers = lambda s, d: view(s, d, CUSTOMER)
events = lambda s, d: view(s, d, EVENT)
rects = lambda s, d: view(s, d, SUPPLIER)
mixed = lambda s, d: view(s, d, MIXED)
RECT = Box.named

# SQL pieces
MX = f"lon*{HALF}e0/180.0e0"
MY = f"ln(tan((greatest(least(lat,{MAX_LAT}e0),-{MAX_LAT}e0)+90.0e0)*pi()/360.0e0))/(pi()/180.0e0)*{HALF}e0/180.0e0"
my_of = lambda c: MY.replace("lat", c)
mx_of = lambda c: MX.replace("lon", c)
TX = lambda x, n: f"CAST(greatest(0, least({n}-1, floor(({x}+{HALF}e0)/{2 * HALF}e0*{n}))) AS INTEGER)"
TY = lambda y, n: f"CAST(greatest(0, least({n}-1, floor(({HALF}e0-({y}))/{2 * HALF}e0*{n}))) AS INTEGER)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by tile at zoom 7."""
    at = customers(spark, sf_dir).select(tile_x(mercator_x("lon"), 7).alias("x"), tile_y(mercator_y("lat"), 7).alias("y"))
    return at.groupBy("x", "y").agg(F.count("*").alias("n"))


register("tile_counts_z7", f"SELECT {TX(MX, 128)} AS x, {TY(MY, 128)} AS y, count(*) AS n FROM ({CUSTOMER}) c GROUP BY 1, 2")(flagship)


@register("mercator_project", f"SELECT c_custkey, round({MX}, 3) AS mx, round({MY}, 3) AS my FROM ({CUSTOMER}) c")
def mercator_project(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", F.round(mercator_x("lon"), 3).alias("mx"), F.round(mercator_y("lat"), 3).alias("my"))


@register("mercator_inverse", f"SELECT c_custkey, round(mx*180.0e0/{HALF}e0, 6) AS lon, round(degrees(2*atan(exp(my*pi()/{HALF}e0))-pi()/2), 6) AS lat FROM (SELECT c_custkey, {MX} AS mx, {MY} AS my FROM ({CUSTOMER}) c) m")
def mercator_inverse(spark, sf_dir):
    m = customers(spark, sf_dir).select("c_custkey", mercator_x("lon").alias("mx"), mercator_y("lat").alias("my"))
    return m.select("c_custkey", F.round(lon_of("mx"), 6).alias("lon"), F.round(lat_of("my"), 6).alias("lat"))


@register("tile_id_z7", f"SELECT c_custkey, {TX(MX, 128)} AS x, {TY(MY, 128)} AS y FROM ({CUSTOMER}) c")
def tile_id(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", tile_x(mercator_x("lon"), 7).alias("x"), tile_y(mercator_y("lat"), 7).alias("y"))


S7 = f"({2 * HALF}e0/128)"


@register("tile_bounds", f"SELECT DISTINCT x, y, round(-{HALF}e0+x*{S7}, 3) AS xmin, round({HALF}e0-y*{S7}-{S7}, 3) + 0.0e0 AS ymin, round(-{HALF}e0+x*{S7}+{S7}, 3) AS xmax, round({HALF}e0-y*{S7}, 3) AS ymax FROM (SELECT {TX(MX, 128)} AS x, {TY(MY, 128)} AS y FROM ({CUSTOMER}) c) t")
def tile_bounds(spark, sf_dir):
    t = tile_id(spark, sf_dir).select("x", "y").distinct()
    b = tile_box(7, F.col("x"), F.col("y"))
    return t.select("x", "y", *(F.round(c, 3).alias(n) for c, n in zip(b.columns(), ("xmin", "ymin", "xmax", "ymax"))))


QUERY_BOX = Box.parse("-60,-30,60,45")


@register("bbox_filter", f"SELECT s_suppkey FROM ({SUPPLIER}) s WHERE xmax >= -60 AND xmin <= 60 AND ymax >= -30 AND ymin <= 45")
def bbox_filter(spark, sf_dir):
    return rects(spark, sf_dir).where(intersects(RECT(), QUERY_BOX)).select("s_suppkey")


@register("bbox_overlap_open", f"SELECT s_suppkey FROM ({SUPPLIER}) s WHERE xmax > -60 AND xmin < 60 AND ymax > -30 AND ymin < 45")
def bbox_overlap_open(spark, sf_dir):
    return rects(spark, sf_dir).where(overlaps(RECT(), QUERY_BOX)).select("s_suppkey")


@register("bbox_contains_eps", f"SELECT s_suppkey FROM ({SUPPLIER}) s WHERE xmin >= -60 - 1e-9 AND ymin >= -30 - 1e-9 AND xmax <= 60 + 1e-9 AND ymax <= 45 + 1e-9")
def bbox_contains_eps(spark, sf_dir):
    return rects(spark, sf_dir).where(contains(QUERY_BOX, RECT())).select("s_suppkey")


@register("point_in_bbox", f"SELECT c_custkey FROM ({CUSTOMER}) c WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 45")
def point_in_bbox(spark, sf_dir):
    return customers(spark, sf_dir).where(contains_point(QUERY_BOX, F.col("lon"), F.col("lat"))).select("c_custkey")


@register("download_filter", f"SELECT id, geom_type FROM ({MIXED}) m WHERE geom_type IS NOT NULL AND (geom_type <> 'Point' OR (xmin BETWEEN -60 AND 60 AND ymin BETWEEN -30 AND 45))")
def download_filter(spark, sf_dir):
    from .serve import wanted

    return mixed(spark, sf_dir).where(wanted(QUERY_BOX, F.col("geom_type"), F.col("xmin"), F.col("ymin"))).select("id", "geom_type")


_GROW = "(greatest(b.xmax, lon) - least(b.xmin, lon)) * (greatest(b.ymax, lat) - least(b.ymin, lat)) - (b.xmax - b.xmin) * (b.ymax - b.ymin)"


@register("assign_partition", f"""
WITH c AS ({CUSTOMER}), b AS (SELECT * FROM {BOXES_SQL}),
s AS (SELECT c_custkey, min(idx) AS first FROM c JOIN b ON b.xmin <= lon AND b.xmax >= lon GROUP BY c_custkey),
k AS (SELECT c.c_custkey, pid, idx, s.first IS NULL OR NOT (lon >= b.xmin - 1e-9 AND lat >= b.ymin - 1e-9 AND lon <= b.xmax + 1e-9 AND lat <= b.ymax + 1e-9) AS o, {_GROW} AS e
  FROM c LEFT JOIN s USING (c_custkey) JOIN b ON s.first IS NULL OR (b.xmin <= lon AND b.idx >= s.first))
SELECT c_custkey, pid AS partition_id FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o, CASE WHEN o THEN e ELSE 0 END, idx) AS n FROM k) r WHERE n = 1
""")
def assign_partition(spark, sf_dir):
    return assign.assign_partitions(customers(spark, sf_dir), BOXES, "lon", "lat").select("c_custkey", "partition_id")


@register("assign_smallest_area", f"""
SELECT s_suppkey, pid AS partition_id FROM (SELECT s_suppkey, pid, row_number() OVER (PARTITION BY s_suppkey ORDER BY (b.xmax - b.xmin) * (b.ymax - b.ymin), b.pid) AS n
  FROM ({SUPPLIER}) s JOIN {BOXES_SQL} ON b.xmax >= s.xmin AND b.xmin <= s.xmax AND b.ymax >= s.ymin AND b.ymin <= s.ymax) r WHERE n = 1
""")
def assign_smallest_area(spark, sf_dir):
    return assign.assign_smallest_area(rects(spark, sf_dir), BOXES, RECT()).select("s_suppkey", "partition_id")


_OPEN = "s.xmax > b.xmin AND b.xmax > s.xmin AND s.ymax > b.ymin AND b.ymax > s.ymin"


@register("overlap_partitions", f"SELECT s_suppkey, pid AS partition_id FROM ({SUPPLIER}) s JOIN {BOXES_SQL} ON {_OPEN}")
def overlap_partitions(spark, sf_dir):
    return assign.overlapping_partitions(rects(spark, sf_dir), BOXES, RECT(), place_empty=False).select("s_suppkey", "partition_id")


@register("overlap_best", f"""
SELECT s_suppkey, coalesce(pid, 0) AS partition_id FROM (SELECT s.s_suppkey, b.pid, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY
   greatest(0.0e0, least(180.0e0, greatest(b.xmax, s.xmax)) - greatest(-180.0e0, least(b.xmin, s.xmin))) * greatest(0.0e0, least(85.0e0, greatest(b.ymax, s.ymax)) - greatest(-85.0e0, least(b.ymin, s.ymin)))
   - greatest(0.0e0, least(180.0e0, b.xmax) - greatest(-180.0e0, b.xmin)) * greatest(0.0e0, least(85.0e0, b.ymax) - greatest(-85.0e0, b.ymin)),
   (b.xmax - b.xmin) * (b.ymax - b.ymin), b.pid) AS n
  FROM ({SUPPLIER}) s LEFT JOIN {BOXES_SQL} ON {_OPEN}) r WHERE n = 1
""")
def overlap_best(spark, sf_dir):
    return assign.best_partition(rects(spark, sf_dir), BOXES, RECT(), Box(-180.0, -85.0, 180.0, 85.0)).select("s_suppkey", "partition_id")


def _cover_sql(z: str, n: str) -> str:
    return f"""(SELECT s_suppkey, z, {TX(mx_of('xmin'), n)} AS a, {TX(mx_of('xmax'), n)} AS b, {TY(my_of('ymax'), n)} AS c, {TY(my_of('ymin'), n)} AS d FROM ({SUPPLIER}) s, (SELECT unnest(range({z})) AS z) q)"""


@register("tile_cover", f"SELECT s_suppkey, CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT s_suppkey, z, c, d, unnest(range(a, b + 1)) AS x FROM {_cover_sql('6', 'CAST(pow(2, z) AS INTEGER)')} t) u, LATERAL (SELECT unnest(range(c, d + 1)) AS y) v")
def tile_cover(spark, sf_dir):
    return tiles.tile_cover(rects(spark, sf_dir), RECT(), range(6)).select("s_suppkey", "z", "x", "y")


def _morton_sql(bits: int = 16) -> str:
    up = lambda v: "+".join(f"((({v}) >> {i}) & 1) * {1 << (2 * i)}" for i in range(bits))
    return f"2 * ({up('iy')}) + {up('ix')}"


_SCALED = f"SELECT c_custkey, CAST(floor(greatest(0, least(1, (lon + 180)/360.0e0)) * 65535.0e0) AS BIGINT) AS ix, CAST(floor(greatest(0, least(1, (lat + 85)/170.0e0)) * 65535.0e0) AS BIGINT) AS iy FROM ({CUSTOMER}) c"


def _codes(spark, sf_dir) -> DataFrame:
    lit = lambda v: F.lit(float(v))
    return customers(spark, sf_dir).select("c_custkey", morton(scaled(F.col("lon"), lit(-180), lit(180), 16), scaled(F.col("lat"), lit(-85), lit(85), 16)).alias("code"))


@register("morton_code", f"SELECT c_custkey, CAST({_morton_sql()} AS BIGINT) AS code FROM ({_SCALED}) s")
def morton_code(spark, sf_dir):
    return _codes(spark, sf_dir)


@register("zorder_rank", f"SELECT c_custkey, region, row_number() OVER (PARTITION BY region ORDER BY code, c_custkey) AS rank FROM (SELECT c_custkey, c_custkey % 8 AS region, {_morton_sql()} AS code FROM ({_SCALED}) s) t")
def zorder_rank(spark, sf_dir):
    w = Window.partitionBy("region").orderBy("code", "c_custkey")
    return _codes(spark, sf_dir).withColumn("region", F.col("c_custkey") % 8).select("c_custkey", "region", F.row_number().over(w).cast("bigint").alias("rank"))


@register("column_sort_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def column_sort_rank(spark, sf_dir):
    w = Window.partitionBy("o_orderstatus").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rank"))


_VERTICES = f"SELECT lon, lat FROM ({EVENT}) e UNION ALL SELECT xmin, ymin FROM ({SUPPLIER}) s UNION ALL SELECT xmax, ymin FROM ({SUPPLIER}) s UNION ALL SELECT xmax, ymax FROM ({SUPPLIER}) s UNION ALL SELECT xmin, ymax FROM ({SUPPLIER}) s UNION ALL SELECT xmin, ymin FROM ({SUPPLIER}) s"


def _cells_sql(source: str, n: int = 4096) -> str:
    return f"SELECT {n - 1} - CAST(greatest(0, least({n - 1}, floor(({MY}+{HALF}e0)/{2 * HALF}e0*{n}))) AS INTEGER) AS iy, {TX(MX, n)} AS ix, count(*) AS cnt FROM ({source}) v GROUP BY 1, 2"


def _ring(spark, sf_dir) -> DataFrame:
    corners = F.array(*(F.struct(F.col(a).alias("lon"), F.col(b).alias("lat")) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))))
    return events(spark, sf_dir).select("lon", "lat").union(rects(spark, sf_dir).select(F.explode(corners).alias("v")).select("v.lon", "v.lat"))


@register("vertex_histogram", _cells_sql(_VERTICES))
def vertex_histogram(spark, sf_dir):
    return tiles.vertex_histogram(_ring(spark, sf_dir))


@register("hist_summary", f"SELECT CAST(sum(cnt) AS BIGINT) AS sum, count(*) AS nonzero FROM ({_cells_sql(_VERTICES)}) h")
def hist_summary(spark, sf_dir):
    return tiles.histogram_summary(tiles.vertex_histogram(_ring(spark, sf_dir)))


_PYRAMID = f"SELECT CAST(z AS INTEGER) AS z, CAST(ix >> (12 - z) AS INTEGER) AS x, CAST(iy >> (12 - z) AS INTEGER) AS y, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({_cells_sql(EVENT)}) h, (SELECT CAST(unnest(range(8)) AS INTEGER) AS z) q GROUP BY 1, 2, 3"


def _event_pyramid(spark, sf_dir):
    return tiles.pyramid(tiles.vertex_histogram(events(spark, sf_dir)), 7)


@register("hist_pyramid", _PYRAMID)
def hist_pyramid(spark, sf_dir):
    return _event_pyramid(spark, sf_dir)


@register("nonempty_tiles", f"SELECT z, x, y FROM ({_PYRAMID}) p WHERE cnt >= 5")
def nonempty_tiles(spark, sf_dir):
    return tiles.nonempty_tiles(_event_pyramid(spark, sf_dir), 5)


@register("tile_cover_nonempty", f"""
WITH p AS ({_PYRAMID}), t AS (SELECT * FROM {_cover_sql('8', 'CAST(pow(2, z) AS INTEGER)')} t)
SELECT t.s_suppkey, p.z, p.x, p.y FROM t JOIN p ON p.z = t.z AND p.x BETWEEN t.a AND t.b AND p.y BETWEEN t.c AND t.d WHERE cnt >= 5
""")
def tile_cover_nonempty(spark, sf_dir):
    return tiles.tile_cover_counted(rects(spark, sf_dir), RECT(), range(8), tiles.vertex_histogram(events(spark, sf_dir)), 5).select("s_suppkey", "z", "x", "y")


@register("tile_cover_threshold0", f"SELECT s_suppkey, CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT s_suppkey, z, c, d, unnest(range(a, b + 1)) AS x FROM {_cover_sql('7', 'CAST(pow(2, z) AS INTEGER)')} t) u, LATERAL (SELECT unnest(range(c, d + 1)) AS y) v")
def tile_cover_threshold0(spark, sf_dir):
    return tiles.tile_cover_counted(rects(spark, sf_dir), RECT(), range(7), tiles.vertex_histogram(events(spark, sf_dir)), 0).select("s_suppkey", "z", "x", "y")


@register("tile_cover_z14", f"""
WITH h AS ({_cells_sql(EVENT)}), q AS (SELECT CAST(unnest(range(13, 15)) AS INTEGER) AS z), t AS (SELECT * FROM {_cover_sql('15', 'CAST(pow(2, z) AS INTEGER)')} t WHERE z >= 13),
u AS (SELECT h.ix, h.iy, h.cnt, q.z, CAST(pow(2, q.z - 12) AS INTEGER) AS n FROM h, q WHERE h.cnt / pow(4, q.z - 12) >= 0.05),
v AS (SELECT z, cnt, iy, n, ix * n + i AS x FROM u, LATERAL (SELECT unnest(range(n)) AS i) a), w AS (SELECT z, x, iy * n + j AS y FROM v, LATERAL (SELECT unnest(range(n)) AS j) b)
SELECT t.s_suppkey, w.z, CAST(w.x AS INTEGER) AS x, CAST(w.y AS INTEGER) AS y FROM t JOIN w ON w.z = t.z AND w.x BETWEEN t.a AND t.b AND w.y BETWEEN t.c AND t.d
""")
def tile_cover_z14(spark, sf_dir):
    return tiles.tile_cover_counted(rects(spark, sf_dir), RECT(), range(13, 15), tiles.vertex_histogram(events(spark, sf_dir)), 0.05).select("s_suppkey", "z", "x", "y")


@register("hist_overzoom", f"SELECT DISTINCT 14 AS z, 4*ix + 1 AS x, 4*iy + 2 AS y, cnt/16.0e0 AS cnt FROM ({_cells_sql(EVENT)}) h")
def hist_overzoom(spark, sf_dir):
    cells = tiles.vertex_histogram(events(spark, sf_dir))
    wanted = cells.select(F.lit(14).alias("z"), (F.col("ix") * 4 + 1).alias("x"), (F.col("iy") * 4 + 2).alias("y"))
    return tiles.overzoom(wanted, cells)


@register("prefix_sum_2d", f"""
WITH h AS ({_cells_sql(EVENT, 16)}), g AS (SELECT CAST(a.i AS INTEGER) AS iy, CAST(b.i AS INTEGER) AS ix FROM (SELECT unnest(range(16)) AS i) a, (SELECT unnest(range(16)) AS i) b)
SELECT g.iy, g.ix, CAST(coalesce((SELECT sum(cnt) FROM h WHERE h.iy <= g.iy AND h.ix <= g.ix), 0) AS BIGINT) AS total FROM g
""")
def prefix_sum_2d(spark, sf_dir):
    return tiles.prefix_sums(tiles.vertex_histogram(events(spark, sf_dir), zoom=4), 16)


@register("global_mbr", f"SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax, count(*) AS n FROM ({CUSTOMER}) c")
def global_mbr(spark, sf_dir):
    return customers(spark, sf_dir).agg(F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"), F.count("*").alias("n"))


_ASSIGNED = ORACLES["assign_partition"]


@register("partition_bbox", f"SELECT partition_id, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax, count(*) AS n FROM ({CUSTOMER}) c JOIN ({_ASSIGNED}) a USING (c_custkey) GROUP BY 1")
def partition_bbox(spark, sf_dir):
    at = assign.assign_partitions(customers(spark, sf_dir), BOXES, "lon", "lat")
    return at.groupBy("partition_id").agg(F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"), F.count("*").alias("n"))


def _unpivoted(df: DataFrame, columns: list[str], round_to: int = 6) -> DataFrame:
    """One row of statistics for each column, from one aggregation."""
    aggs = {f"{n}|{k}": a for n in columns for k, a in stats.column_aggregates(n, df.schema[n].dataType, sketch=False).items()}
    keys = list(dict.fromkeys(k.split("|")[1] for k in aggs))
    row = df.agg(*(a.alias(k) for k, a in aggs.items()))
    timed = {n for n in columns if stats.kind_of(df.schema[n].dataType) == "time"}
    number = lambda c, n: (c.cast("timestamp") if n in timed else c).cast("double")
    shown = lambda c, k, n: F.round(number(c, n) if k in ("min", "max") else c, round_to) if k in ("mean", "stddev", "avg_length", "min", "max") else c.cast("bigint")
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), *(shown(F.col(f"`{n}|{k}`"), k, n).alias(k) for k in keys)) for n in columns))).alias("s")).select("s.*")


_numeric = lambda c, t: f"SELECT '{c}' AS name, count({c}) AS non_null_count, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS stddev FROM {t}"


@register("numeric_stats", " UNION ALL ".join(_numeric(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def numeric_stats(spark, sf_dir):
    return _unpivoted(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("text_stats", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS non_null_count, round(avg(length({c})), 6) AS avg_length, CAST(min(length({c})) AS BIGINT) AS min_length, CAST(max(length({c})) AS BIGINT) AS max_length FROM documents" for c in ("text", "lang", "source")))
def text_stats(spark, sf_dir):
    return _unpivoted(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@register("categorical_stats", "SELECT 'is_open' AS name, count(*) AS non_null_count, count(*) FILTER (o_orderstatus = 'O') AS n_true, count(*) FILTER (o_orderstatus <> 'O') AS n_false FROM orders")
def categorical_stats(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "O").alias("is_open"))
    text = stats._text(F.col("is_open"), df.schema["is_open"].dataType)
    return df.agg(F.count("is_open").alias("non_null_count"), F.count_if(text == "True").alias("n_true"), F.count_if(text == "False").alias("n_false")).select(F.lit("is_open").alias("name"), "*")


@register("timestamp_stats", "SELECT 'o_orderdate' AS name, count(o_orderdate) AS non_null_count, round(epoch(min(o_orderdate)), 3) AS min, round(epoch(max(o_orderdate)), 3) AS max, round(avg(epoch(o_orderdate)), 3) AS mean, round(stddev_pop(epoch(o_orderdate)), 3) AS stddev FROM orders")
def timestamp_stats(spark, sf_dir):
    return _unpivoted(table(spark, sf_dir, "orders"), ["o_orderdate"], 3)


def _top_sql(t: str, c: str) -> str:
    return f"SELECT '{c}' AS name, value, count FROM (SELECT value, count, sum(count) OVER () AS top, (SELECT count({c}) FROM {t}) AS total FROM (SELECT {c} AS value, count(*) AS count FROM {t} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) k) q WHERE top >= 0.8 * total"


@register("topk_80pct", " UNION ALL ".join((_top_sql("orders", "o_orderpriority"), _top_sql("part", "p_brand"), _top_sql("part", "p_name"))))
def topk_80pct(spark, sf_dir):
    out = None
    for t, c in (("orders", "o_orderpriority"), ("part", "p_brand"), ("part", "p_name")):
        top = stats.top_values(table(spark, sf_dir, t), c).select(F.lit(c).alias("name"), "value", "count")
        out = top if out is None else out.union(top)
    return out


@register("approx_distinct_ok", "SELECT 'o_custkey' AS name, true AS ok UNION ALL SELECT 'o_orderkey', true")
def approx_distinct_ok(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    near = lambda c: (F.abs(stats.approx_distinct(F.col(c)) - F.countDistinct(c)) < F.lit(0.1) * F.countDistinct(c)).alias(c)
    row = orders.agg(near("o_custkey"), near("o_orderkey"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("ok")) for c in row.columns))).alias("s")).select("s.*")


@register("geometry_stats", f"SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) FILTER (geom_type = 'Point') AS n_point, count(*) FILTER (geom_type = 'Polygon') AS n_polygon, CAST(sum(n_points) FILTER (geom_type = 'Point') AS BIGINT) AS total_points FROM ({MIXED}) m")
def geometry_stats(spark, sf_dir):
    got = stats.geometry_stats(mixed(spark, sf_dir).withColumn("bbox", RECT().struct()))
    return got.select("xmin", "ymin", "xmax", "ymax", F.col("geom_types")["Point"].alias("n_point"), F.col("geom_types")["Polygon"].alias("n_polygon"), "total_points")


@register("reservoir_sample", "SELECT least(count(*), 500) AS n, true AS inside FROM customer")
def reservoir_sample(spark, sf_dir):
    return sampling.reservoir(table(spark, sf_dir, "customer"), "c_custkey", 500).agg(F.count("*").alias("n"), (F.min("c_custkey") >= 0).alias("inside"))


@register("bernoulli_sample", "SELECT true AS near FROM (SELECT 1) t")
def bernoulli_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.agg(F.count("*").alias("all")).crossJoin(sampling.bernoulli(orders, 0.2, key="o_orderkey").agg(F.count("*").alias("some"))).select((F.abs(F.col("some") / F.col("all") - 0.2) < 0.05).alias("near"))


@register("tile_feature_cap", f"SELECT x, y, least(n, 3) AS n FROM (SELECT {TX(MX, 128)} AS x, {TY(MY, 128)} AS y, count(*) AS n FROM ({EVENT}) e GROUP BY 1, 2) t")
def tile_feature_cap(spark, sf_dir):
    at = events(spark, sf_dir).select("event_id", tile_x(mercator_x("lon"), 7).alias("x"), tile_y(mercator_y("lat"), 7).alias("y"))
    return tiles.cap_features(at, 3, ("x", "y"), ("event_id",)).groupBy("x", "y").agg(F.count("*").alias("n"))


@register("point_weights", "SELECT c_custkey, c_nationkey AS bin, CAST(floor((1000 + 37*c_nationkey) / count(*) OVER (PARTITION BY c_nationkey)) AS BIGINT) AS weight FROM customer")
def point_weights(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("bin"))
    bins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("bin"), (F.col("n_nationkey") * 37 + 1000).alias("value"))
    return assign.point_weights(c, bins).select("c_custkey", "bin", "weight")


@register("cumulative_weight", "SELECT c_custkey, CAST(sum(c_custkey % 10) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM customer")
def cumulative_weight(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("weight", F.col("c_custkey") % 10)
    return assign.cumulative_weight(c, "c_custkey", group=("c_nationkey",)).select("c_custkey", "cumulative")


@register("tile_coords", f"SELECT c_custkey, round(({MX} - (-{HALF}e0 + {TX(MX, 128)}*{S7}))/{S7}*4096.0e0, 3) AS tx, round(({MY} - ({HALF}e0 - {TY(MY, 128)}*{S7} - {S7}))/{S7}*4096.0e0, 3) AS ty FROM ({CUSTOMER}) c")
def tile_coords(spark, sf_dir):
    m = customers(spark, sf_dir).select("c_custkey", mercator_x("lon").alias("mx"), mercator_y("lat").alias("my"))
    m = m.withColumns({"x": tile_x("mx", 7), "y": tile_y("my", 7)})
    tx, ty = in_tile(F.col("mx"), F.col("my"), tile_box(7, F.col("x"), F.col("y")))
    return m.select("c_custkey", F.round(tx, 3).alias("tx"), F.round(ty, 3).alias("ty"))


@register("clip_rect", f"SELECT s_suppkey, greatest(xmin, -60.0e0) AS xmin, greatest(ymin, -30.0e0) AS ymin, least(xmax, 60.0e0) AS xmax, least(ymax, 45.0e0) AS ymax FROM ({SUPPLIER}) s WHERE xmax > -60 AND xmin < 60 AND ymax > -30 AND ymin < 45")
def clip_rect(spark, sf_dir):
    c = clipped(RECT(), QUERY_BOX)
    return rects(spark, sf_dir).where(overlaps(RECT(), QUERY_BOX)).select("s_suppkey", *(v.alias(n) for v, n in zip(c.columns(), ("xmin", "ymin", "xmax", "ymax"))))


@register("drop_null_props", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS n_props FROM nation")
def drop_null_props(spark, sf_dir):
    from .serve import without_nulls

    n = table(spark, sf_dir, "nation").select("n_nationkey", F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey").cast("string"))).alias("p"))
    return n.select("n_nationkey", F.size(without_nulls(F.col("p"))).alias("n_props"))


@register("feature_json", """SELECT n_nationkey, '{"type":"Feature","properties":{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}}' AS feature FROM nation""")
def feature_json(spark, sf_dir):
    from .serve import feature_json as as_json

    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", as_json(F.struct("n_name", "n_regionkey")).alias("feature"))


@register("filename_roundtrip", f"SELECT partition_id, 'tile_' || lpad(CAST(partition_id AS VARCHAR), 6, '0') || '__' || translate(printf('%.6f', xmin) || '_' || printf('%.6f', ymin) || '_' || printf('%.6f', xmax) || '_' || printf('%.6f', ymax), '.', '_') || '.parquet' AS name, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax FROM ({ORACLES['partition_bbox']}) p")
def filename_roundtrip(spark, sf_dir):
    named = partition_bbox(spark, sf_dir).select("partition_id", tile_file_name(F.col("partition_id"), RECT()).alias("name"))
    back = parsed_file_name(F.col("name"))
    return named.select("partition_id", "name", back.xmin.alias("xmin"), back.ymax.alias("ymax"))


_NAMES = "SELECT r_name AS id FROM region UNION ALL SELECT n_name FROM nation"
_TITLE = "list_aggregate(list_transform(string_split(replace(id, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ')"


@register("catalog_search", f"SELECT id, {_TITLE} AS name FROM ({_NAMES}) n WHERE lower(id) LIKE '%a%'")
def catalog_search(spark, sf_dir):
    from terrazzo.sources.catalog import display_name, name_matches

    both = table(spark, sf_dir, "region").select(F.col("r_name").alias("id")).union(table(spark, sf_dir, "nation").select("n_name"))
    return both.where(name_matches(F.col("id"), "A")).select("id", display_name(F.col("id")).alias("name"))


@register("union_promote", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union_promote(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s, allowMissingColumns=True)


# Without SQL: covered by tests/.


@register("rsgrove_partitions")
def rsgrove_partitions(spark, sf_dir):
    from terrazzo.sources.geoparquet import index_frame

    from .build import build_index

    points = customers(spark, sf_dir).select(F.col("lon").alias("cx"), F.col("lat").alias("cy"))
    return index_frame(spark, build_index(points, 16))


def _wkb_rects(spark, sf_dir) -> DataFrame:
    from terrazzo.functions.udfs import from_geojson

    ring = F.concat(*(x for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")) for x in (F.lit("["), F.col(a), F.lit(","), F.col(b), F.lit("],"))))
    text = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.expr("substring(r, 1, length(r) - 1)"), F.lit("]]}"))
    return rects(spark, sf_dir).withColumn("r", ring).withColumn("geometry", from_geojson(text)).drop("r")


@register("wkb_roundtrip", f"SELECT s_suppkey, 'Polygon' AS geom_type, round(least(xmin, xmax), 6) AS xmin, round(least(ymin, ymax), 6) AS ymin, round(greatest(xmin, xmax), 6) AS xmax, round(greatest(ymin, ymax), 6) AS ymax, round((xmin + xmax)/2, 6) AS cx, round((ymin + ymax)/2, 6) AS cy FROM ({SUPPLIER}) s")
def wkb_roundtrip(spark, sf_dir):
    from terrazzo.functions.udfs import from_geojson, to_geojson, with_geometry_columns

    back = _wkb_rects(spark, sf_dir).select("s_suppkey", from_geojson(to_geojson("geometry")).alias("geometry"))
    g = with_geometry_columns(back)
    return g.select("s_suppkey", "geom_type", *(F.round(F.col("bbox")[c], 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@register("geojson_scan")
def geojson_scan(spark, sf_dir):
    """The supplier rectangles as GeoJSON text and back: type, vertices and box."""
    from terrazzo.functions.udfs import to_geojson, with_geometry_columns
    from terrazzo.sources.geojson import features_of

    text = _wkb_rects(spark, sf_dir).select(F.concat(F.lit('{"type":"Feature","properties":{"id":'), "s_suppkey", F.lit('},"geometry":'), to_geojson("geometry"), F.lit("}")).alias("value"))
    g = with_geometry_columns(features_of(text.select(F.parse_json("value").alias("f")), T.StructType([T.StructField("id", T.LongType())])))
    return g.select("id", "geom_type", *(F.round(F.col("bbox")[c], 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


@register("simplify_line")
def simplify_line(spark, sf_dir):
    """The customers of each hundred keys as a line in order of their keys, and what simplification leaves of it."""
    from terrazzo.functions import shapes

    @F.pandas_udf("int")
    def left(lines: pd.Series) -> pd.Series:
        return pd.Series([len(shapes.simplify_line([[p["lon"], p["lat"]] for p in line], 5.0)) for line in lines])

    point = customers(spark, sf_dir).select(F.floor(F.col("c_custkey") / 100).alias("line_id"), F.struct("c_custkey", "lon", "lat").alias("p"))
    lines = point.groupBy("line_id").agg(F.array_sort(F.collect_list("p")).alias("line"))  # a hundred points each
    return lines.select("line_id", F.size("line").alias("n"), left(F.col("line")).alias("n_left"))


@register("mvt_encode")
def mvt_encode(spark, sf_dir):
    from terrazzo.functions.udfs import with_geometry_columns

    from .build import histogram, rendered

    f = with_geometry_columns(_wkb_rects(spark, sf_dir).select("s_suppkey", "geometry")).select("s_suppkey", "bbox", "geometry")
    return rendered(f, histogram(f), 4)
