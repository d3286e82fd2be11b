"""Vertex histograms, their zoom pyramid, and the cover of features by map tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.functions.boxes import Box
from terrazzo.functions.mercator import HALF, mercator_x, mercator_y, tile_x, tile_y

GRID_ZOOM = 12  # a 4096 x 4096 grid


def vertex_histogram(vertices: DataFrame, lon: str = "lon", lat: str = "lat", zoom: int = GRID_ZOOM) -> DataFrame:
    """Sparse counts (iy, ix, cnt) of vertices on the grid of 2**zoom cells a side; row 0 is north."""
    n = 1 << zoom
    cell = lambda t: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(t * F.lit(n)).cast("int")))
    kept = vertices.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    ix = cell((mercator_x(lon) + F.lit(HALF)) / F.lit(2 * HALF))
    iy = F.lit(n - 1) - cell((mercator_y(lat) + F.lit(HALF)) / F.lit(2 * HALF))
    return kept.select(iy.alias("iy"), ix.alias("ix")).groupBy("iy", "ix").agg(F.count("*").alias("cnt"))


def histogram_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("sum"), F.count("*").alias("nonzero"))


def cells_box(cells: DataFrame, zoom: int = GRID_ZOOM) -> DataFrame:
    """The Mercator box of the cells that have vertices, as one row; nulls without any."""
    size = 2 * HALF / (1 << zoom)
    return cells.agg(
        (F.min("ix") * size - HALF).alias("xmin"), (F.lit(HALF) - (F.max("iy") + 1) * size).alias("ymin"),
        ((F.max("ix") + 1) * size - HALF).alias("xmax"), (F.lit(HALF) - F.min("iy") * size).alias("ymax"),
    )


def pyramid(cells: DataFrame, last: int, zoom: int = GRID_ZOOM) -> DataFrame:
    """Counts (z, x, y, cnt) of all tiles with vertices at zooms 0..last, last at most the grid's zoom.

    Each level sums the one below it, so a level never has more rows than the grid.
    """
    if last > zoom:
        raise ValueError("levels beyond the grid come from overzoom()")
    shift = F.lit(zoom) - F.col("z")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), shift)).cast("int")
    base = cells.select(F.shiftright("ix", zoom - last).alias("ix"), F.shiftright("iy", zoom - last).alias("iy"), "cnt").groupBy("ix", "iy").agg(F.sum("cnt").alias("cnt"))
    levels = base.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("z"), "ix", "iy", "cnt")
    shift = F.lit(last) - F.col("z")
    return levels.select("z", at("ix").alias("x"), at("iy").alias("y"), "cnt").groupBy("z", "x", "y").agg(F.sum("cnt").alias("cnt"))


def overzoom(tiles: DataFrame, cells: DataFrame, zoom: int = GRID_ZOOM) -> DataFrame:
    """The share of their grid cell for tiles (z, x, y) with z beyond the grid."""
    scale = F.pow(F.lit(2.0), F.col("z") - F.lit(zoom))
    with_cell = tiles.withColumns({"ix": F.floor(F.col("x") / scale).cast("int"), "iy": F.floor(F.col("y") / scale).cast("int")})
    return with_cell.join(cells, ["ix", "iy"], "left").select("z", "x", "y", (F.coalesce("cnt", F.lit(0)) / (scale * scale)).alias("cnt"))


def nonempty_tiles(counts: DataFrame, threshold: float = 0) -> DataFrame:
    """Tiles that count, of those with vertices: counts of at least the threshold (all tiles count where that is 0)."""
    return counts.where(F.col("cnt") >= threshold).select("z", "x", "y")


def prefix_sums(cells: DataFrame, side: int) -> DataFrame:
    """The dense summed-area table (iy, ix, total) of a side x side grid, for export."""
    spark = cells.sparkSession
    grid = spark.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("iy"), (F.col("id") % side).cast("int").alias("ix"))
    dense = grid.join(cells, ["iy", "ix"], "left").select("iy", "ix", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    upto = lambda part, by: Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    rows = dense.withColumn("r", F.sum("cnt").over(upto("iy", "ix")))
    return rows.select("iy", "ix", F.sum("r").over(upto("ix", "iy")).cast("bigint").alias("total"))


def tile_range(box: Box, z: Column | int) -> tuple[Column, Column, Column, Column]:
    """First and last tile column and row of a Mercator box."""
    x0, y0, x1, y1 = box.columns()
    return tile_x(x0, z), tile_x(x1, z), tile_y(y1, z), tile_y(y0, z)


def _metres(box: Box) -> Column:
    x0, y0, x1, y1 = box.columns()
    return F.struct(mercator_x(x0).alias("xmin"), mercator_y(y0).alias("ymin"), mercator_x(x1).alias("xmax"), mercator_y(y1).alias("ymax"))


def tile_cover(features: DataFrame, box: Box, zooms: range) -> DataFrame:
    """One row (all columns, z, x, y) for each tile that the feature's lon/lat box meets."""
    a, b, c, d = tile_range(Box.of("__m"), F.col("z"))
    out = features.withColumn("__m", _metres(box)).withColumn("z", F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[-1]))))
    return out.withColumn("x", F.explode(F.sequence(a, b))).withColumn("y", F.explode(F.sequence(c, d))).drop("__m")


SMALL_ZOOM = 8  # a level has 4**8 tiles at most, a table of about a megabyte


def tile_cover_counted(features: DataFrame, box: Box, zooms: range, cells: DataFrame, threshold: float, grid: int = GRID_ZOOM) -> DataFrame:
    """The rows of tile_cover whose tile counts: its vertices, of the grid's cells, reach the threshold.

    A tile beyond the grid has an even share of its cell. With a threshold of 0 or less every tile
    counts. Else counts never grow towards the leaves, so the tiles are descended in one chain, a
    tile's children only where the tile counts: a large box does not unfold into tiles that do not.
    Levels of up to SMALL_ZOOM are met without a shuffle, as their size is bounded.
    """
    if threshold <= 0:
        return tile_cover(features, box, zooms)
    last = zooms[-1]
    kept = pyramid(cells, min(last, grid), grid).where(F.col("cnt") >= threshold)
    of = lambda z, x, y, cnt: F.struct(z.cast("int").alias("z"), x.cast("int").alias("x"), y.cast("int").alias("y"), cnt.cast("bigint").alias("cnt"))
    rows = features.withColumn("__m", _metres(box)).withColumn("__t", of(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    for z in range(last + 1):
        at = F.col("__t")
        if z:
            a, b, c, d = tile_range(Box.of("__m"), z)
            x0, x1, y0, y1 = F.greatest(a, at["x"] * 2), F.least(b, at["x"] * 2 + 1), F.greatest(c, at["y"] * 2), F.least(d, at["y"] * 2 + 1)
            below = F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: of(F.lit(z), x, y, at["cnt"]))))
            some = (at["z"] == z - 1) & (x0 <= x1) & (y0 <= y1)
            rows = rows.withColumn("__t", F.explode(F.when(some, F.concat(F.array(at), below)).otherwise(F.array(at))))
        if z <= grid:
            level = kept.where(F.col("z") == z).select(F.col("z").alias("__z"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("cnt").alias("__n"))
            level = F.broadcast(level) if z <= SMALL_ZOOM else level
            rows = rows.join(level, (at["z"] == F.col("__z")) & (at["x"] == F.col("__x")) & (at["y"] == F.col("__y")), "left")
            rows = rows.where((at["z"] < z) | F.col("__n").isNotNull()).withColumn("__t", of(at["z"], at["x"], at["y"], F.coalesce("__n", at["cnt"]))).drop("__z", "__x", "__y", "__n")
        else:
            rows = rows.where((at["z"] < z) | (at["cnt"] / F.lit(4.0 ** (z - grid)) >= threshold))
    return rows.where(F.col("__t.z") >= zooms[0]).withColumns({c: F.col("__t")[c] for c in ("z", "x", "y")}).drop("__m", "__t")


def cap_features(features: DataFrame, cap: int, by: tuple[str, ...] = ("z", "x", "y"), order: tuple[str, ...] = ("id",), seed: int = 0) -> DataFrame:
    """At most `cap` features a tile, picked by a hash of their id."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(*order, F.lit(seed)), *order)
    return features.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= cap).drop("__rank")
