"""The main dataflows: tile(), generate_mvt() and build()."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions import mvt
from terrazzo.functions.boxes import Box, morton, scaled
from terrazzo.functions.udfs import vertices, with_geometry_columns
from terrazzo.operators import assign, sampling, stats, tiles
from terrazzo.operators.partitioner import Options, partition_count, partition_points
from terrazzo.sources import files, geoparquet
from terrazzo.sources.catalog import Dataset, parse_size
from terrazzo.sources.crs import in_degrees, source_crs

SAMPLE_MOST = 1_000_000  # centroids that reach the driver
CAP = 25_000  # features of a tile
ORDERS = ("zorder", "hilbert", "columns", "none")


@dataclass
class TileResult:
    outdir: str
    num_files: int
    total_rows: int
    bbox: tuple[float, float, float, float] | None
    histogram_path: str | None


@dataclass
class MVTResult:
    outdir: str
    zoom_levels: list[int]
    tile_count: int


def build_index(features: DataFrame, parts: int, sample_cap: int | None = 10_000, sample_ratio: float = 1.0, seed: int = 42, options: Options = Options()) -> list[tuple]:
    """A partition index from a sample of centroids; with a cap the ratio does not matter.

    Rows are picked by a hash of all they hold, so features that share a coordinate are picked each by
    themselves. Without a cap the sample is of SAMPLE_MOST rows at most, in expectation.
    """
    points = features.where(F.col("cx").isNotNull())
    plain = [f.name for f in points.schema if f.dataType.typeName() not in ("map", "variant")]
    points = points.select("cx", "cy", F.xxhash64(*(F.col(f"`{c}`") for c in plain), F.lit(seed)).alias("__h"))
    if sample_cap is not None:
        points = points.orderBy("__h").limit(sample_cap)
    else:
        ratio = min(sample_ratio, SAMPLE_MOST / max(1, points.count()))
        points = sampling.bernoulli(points, ratio, seed, "__h") if ratio < 1 else points
    got = points.select("cx", "cy").toPandas().sort_values(["cx", "cy"]).to_numpy()
    if not len(got):
        raise ValueError("no feature has a geometry to partition by")
    return partition_points(got, parts, options=options)


def z_code(features: DataFrame, bits: int = 16, partition: str = "partition_id") -> DataFrame:
    """Adds __z, the Z-order code of centroids in their partition's box; rows without one come last."""
    b = Box.of("bbox")
    boxes = features.groupBy(F.col(partition).alias("__pid")).agg(F.min(b.xmin).alias("__x0"), F.min(b.ymin).alias("__y0"), F.max(b.xmax).alias("__x1"), F.max(b.ymax).alias("__y1"))
    # one row for each box of the index, which has assign.MOST boxes at most
    with_box = features.join(F.broadcast(boxes), F.col(partition) == F.col("__pid"), "left")
    code = morton(scaled(F.col("cx"), F.col("__x0"), F.col("__x1"), bits), scaled(F.col("cy"), F.col("__y0"), F.col("__y1"), bits))
    return with_box.withColumn("__z", F.when(F.col("cx").isNotNull(), code).otherwise(F.lit((1 << 62) - 1))).drop("__pid", "__x0", "__y0", "__x1", "__y1")


def histogram(features: DataFrame, geometry: str = "geometry", zoom: int = tiles.GRID_ZOOM) -> DataFrame:
    """Sparse vertex counts of WKB features."""
    v = features.where(F.col(geometry).isNotNull()).select(F.explode(vertices(F.col(geometry))).alias("v"))
    return tiles.vertex_histogram(v.select("v.lon", "v.lat"), zoom=zoom)


def _input_bytes(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def tile(
    spark: SparkSession, input: str, outdir: str, *, num_tiles: int | None = 40, partition_size: int | str = 1 << 30, sort: str = "zorder", sort_keys: tuple = (), compression: str = "zstd",
    sample_cap: int | None = 10_000, sample_ratio: float = 1.0, seed: int = 42, geom_col: str = "geometry", sfc_bits: int = 16, index: str | None = None, with_stats: bool = True, with_histogram: bool = True,
) -> TileResult:
    """Partitions features spatially and writes them, their statistics and their vertex histogram.

    partition_size counts only without num_tiles. index names a CSV of boxes to use instead of a
    sample; then a feature goes to the smallest box it meets and others drop out. sort is zorder
    (also under the name hilbert), columns (by sort_keys, names or (name, ascending)) or none.
    Coordinates in EPSG:3857, as a GeoJSON header or GeoParquet footer states them, become degrees; a
    CRS not understood raises. Paths may be URIs. A dataset already in outdir is replaced: files that
    are not of this run go once the new ones are complete.
    """
    sort = sort if sort in ORDERS else "zorder"
    features = geoparquet.read_features(spark, input, geom_col)
    names = features.columns
    features = features.withColumn(geom_col, in_degrees(F.col(geom_col), source_crs(spark, input, geom_col)))
    features = with_geometry_columns(features, geom_col)
    if index:
        boxes = geoparquet.read_index(spark, index)
        dealt = assign.assign_smallest_area(features, boxes, Box.of("bbox"))
    else:
        if features.isEmpty():
            return TileResult(outdir, 0, 0, None, None)
        parts = partition_count(num_tiles, 0 if num_tiles else _input_bytes(spark, input), parse_size(partition_size))
        dealt = assign.assign_partitions(features, build_index(features, parts, sample_cap, sample_ratio, seed))
    if sort in ("zorder", "hilbert"):
        order, dealt = ["__z"], z_code(dealt, sfc_bits)
    else:
        keys = [(k, True) if isinstance(k, str) else k for k in sort_keys] if sort == "columns" else []
        order = [F.col(name).asc() if ascending else F.col(name).desc() for name, ascending in keys]
    kept = [*[n for n in names if n != geom_col], "geom_type", "n_points", "bbox", geom_col]
    folder = files.join(outdir, "parquet_tiles")
    out = dealt.select(*kept, "partition_id", *(["__z"] if "__z" in dealt.columns else []))
    manifest = geoparquet.write_tiles(out, folder, order, geom_col, compression)
    mine = {m["file"] for m in manifest}
    for old in files.listing(folder):
        if old.base_name not in mine:
            files.delete(files.join(folder, old.base_name))
    for part in ("stats", "histograms"):
        files.delete(files.join(outdir, part))
    files.write_text(files.join(outdir, "manifest.json"), json.dumps(manifest))
    written = spark.read.parquet(folder) if manifest else features.limit(0)
    if with_stats and manifest:
        document = stats.collect_stats(written.select(*[n for n in names if n != geom_col]))
        g = stats.geometry_stats(written).first()
        document.append({"name": geom_col, "stats": {"mbr": [g["xmin"], g["ymin"], g["xmax"], g["ymax"]], "geom_types": g["geom_types"], "total_points": g["total_points"]}})
        files.write_text(files.join(outdir, "stats", "attributes.json"), stats.stats_json(document))
    path = None
    if with_histogram and manifest:
        path = files.join(outdir, "histograms", "global.parquet")
        histogram(written, geom_col).write.mode("overwrite").parquet(path)
        cells, side = spark.read.parquet(path), 1 << tiles.GRID_ZOOM
        about = {"grid_size": side, "shape": [side, side], "crs": "EPSG:3857", "bbox": list(tiles.cells_box(cells).first()), **tiles.histogram_summary(cells).first().asDict()}
        files.write_text(files.join(outdir, "histograms", "global.json"), json.dumps(about))
    return TileResult(outdir, len(manifest), sum(m["n_rows"] for m in manifest), Dataset(outdir).bbox, path)


def rendered(features: DataFrame, counts: DataFrame, zoom: int, threshold: float = 0, geometry: str = "geometry", cap: int = CAP) -> DataFrame:
    """(z, x, y, mvt) of all tiles at zooms 0..zoom whose vertex count reaches the threshold and that have a feature left.

    counts has the grid's cells (iy, ix, cnt); beyond the grid a tile has an even share of its cell.
    """
    inner = [c for c in features.columns if c not in (geometry, "bbox", "geom_type", "n_points", "partition_id")]
    props = F.to_json(F.struct(*inner)) if inner else F.lit("{}")
    slim = features.where(F.col("bbox.xmin").isNotNull()).select("bbox", F.col(geometry).alias("g"), props.alias("p"))
    covered = tiles.tile_cover_counted(slim, Box.of("bbox"), range(zoom + 1), counts, threshold)
    capped = tiles.cap_features(covered, cap, order=("g", "p"))

    def run(batches):
        at, rows = None, []

        def made():
            data = mvt.render(*at, rows)
            return [(*at, data)] if data else []

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(5))
            done = []
            for z, x, y, g, p in zip(*columns):
                if (z, x, y) != at:
                    done += made() if at else []
                    at, rows = (z, x, y), []
                rows.append((g, json.loads(p)))
            if done:
                yield table_of(done)
        if at and (last := made()):
            yield table_of(last)

    def table_of(tiles_made):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*tiles_made), (*[pa.int32()] * 3, pa.binary()))], names=["z", "x", "y", "mvt"])

    # the cap's window has brought the rows of a tile together; a task holds one tile at a time
    return capped.select("z", "x", "y", "g", "p").sortWithinPartitions("z", "x", "y").mapInArrow(run, "z int, x int, y int, mvt binary")


def write_mvt(made: DataFrame, folder: str) -> dict[int, int]:
    """Writes z/x/y.mvt files from the executors and returns the tiles of each zoom."""

    def run(batches):
        store, root = files.store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                store.create_dir(f"{root}/{r['z']}/{r['x']}", recursive=True)
                with store.open_output_stream(f"{root}/{r['z']}/{r['x']}/{r['y']}.mvt") as f:
                    f.write(r["mvt"])
            yield batch.select(["z"])

    return {r["z"]: r["count"] for r in made.mapInArrow(run, "z int").groupBy("z").count().collect()}


def generate_mvt(spark: SparkSession, tile_dir: str, *, zoom: int = 7, threshold: float = 0, outdir: str | None = None, geom_col: str = "geometry") -> MVTResult:
    """Renders the vector tiles of a dataset written by tile(); tiles already in the folder go first."""
    folder = files.join(outdir or tile_dir, "mvt")
    features = spark.read.parquet(files.join(tile_dir, "parquet_tiles"))
    path = files.join(tile_dir, "histograms", "global.parquet")
    counts = spark.read.parquet(path) if files.exists(path) else histogram(features, geom_col)
    files.delete(folder)
    made = write_mvt(rendered(features, counts, zoom, threshold, geom_col), folder)
    return MVTResult(folder, sorted(made), sum(made.values()))


def build(spark: SparkSession, input: str, outdir: str, *, zoom: int = 7, num_tiles: int = 40, threshold: float = 100_000, **options) -> tuple[TileResult, MVTResult]:
    """tile(), then generate_mvt()."""
    done = tile(spark, input, outdir, num_tiles=num_tiles, **options)
    return done, generate_mvt(spark, outdir, zoom=zoom, threshold=threshold)
