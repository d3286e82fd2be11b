"""Queries behind a feature server: downloads, samples, tiles on demand, style prompts."""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions.boxes import Box, contains_point, intersects
from terrazzo.sources import files

MIME = {"csv": "text/csv", "geojson": "application/geo+json", "json": "application/json"}


def wanted(box: Box | None, kind: Column, x: Column, y: Column) -> Column:
    """Whether a download keeps a feature: points inside the box, all others that have a geometry."""
    if box is None:
        return F.lit(True)
    return kind.isNotNull() & F.when(kind == "Point", contains_point(box, x, y)).otherwise(F.lit(True))


def without_nulls(properties: Column) -> Column:
    return F.map_filter(properties, lambda k, v: v.isNotNull())


def feature_json(properties: Column, geometry: Column | None = None) -> Column:
    """A feature as JSON text; geometry is GeoJSON text. Null properties are left out."""
    body = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties))
    if geometry is None:
        return F.concat(body, F.lit("}"))
    return F.concat(body, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))


def read_tiles(spark: SparkSession, dataset: str, box: Box | None = None) -> DataFrame:
    """Features of a dataset, from the tile files whose manifest box meets the box; rows outside go as well."""
    from terrazzo.sources.catalog import Dataset

    d = Dataset(dataset)
    hit = [m for m in d.manifest if box is None or (m["xmin"] is not None and m["xmax"] >= box.xmin and m["xmin"] <= box.xmax and m["ymax"] >= box.ymin and m["ymin"] <= box.ymax)]
    if not d.manifest:
        raise FileNotFoundError(f"{dataset} has no manifest")
    df = spark.read.parquet(*(files.join(d.path, "parquet_tiles", m["file"]) for m in hit or d.manifest[:1]))
    if box is None:
        return df
    return df.where(intersects(Box.of("bbox"), box)) if hit else df.limit(0)


def features(spark: SparkSession, dataset: str, box: Box | None = None, geometry: bytes | None = None) -> DataFrame:
    """The features of a download: by box, or by the box of a WKB geometry."""
    from terrazzo.functions import wkb

    if geometry is not None:
        b = wkb.bounds(wkb.decode(geometry))
        box = Box(*b)
    df = read_tiles(spark, dataset, box)
    return df if box is None else df.where(wanted(box, F.col("geom_type"), F.col("bbox.xmin"), F.col("bbox.ymin")))


def stream(df: DataFrame, kind: str) -> Iterator[str]:
    """The lines of a csv or geojson download, row by row from the executors."""
    from terrazzo.functions.udfs import to_geojson

    inner = [c for c in df.columns if c not in ("geometry", "bbox", "geom_type", "n_points", "partition_id")]
    if kind == "geojson":
        yield '{"type":"FeatureCollection","features":['
        lead = ""
        for r in df.select(feature_json(F.struct(*inner), to_geojson("geometry")).alias("f")).toLocalIterator(prefetchPartitions=True):
            yield lead + r["f"]
            lead = ","
        yield "]}"
    elif kind == "csv":
        cell = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"' if re.search(r'[",\r\n]', str(v)) else str(v)
        yield ",".join([*inner, "geometry_type", "x", "y"]) + "\n"
        point = F.col("geom_type") == "Point"
        for r in df.select(*inner, "geom_type", F.when(point, F.col("bbox.xmin")), F.when(point, F.col("bbox.ymin"))).toLocalIterator(prefetchPartitions=True):
            yield ",".join(cell(v) for v in r) + "\n"
    else:
        raise ValueError(f"no such format: {kind}")


def sample(spark: SparkSession, dataset: str, box: Box) -> DataFrame:
    """One feature inside the box."""
    return features(spark, dataset, box).limit(1)


def attribute_stats(dataset: str, names: list[str] | None = None) -> list[dict]:
    """The statistics of a dataset's attributes, or of those named."""
    found = json.loads(files.read_text(files.join(dataset, "stats", "attributes.json")))["attributes"]
    return found if names is None else [a for a in found if a["name"] in set(names)]


def style_prompt(dataset: str, names: list[str] | None = None) -> str:
    """What a language model is asked for map styles."""
    return "Suggest map styles for these attributes. Answer with a JSON array of objects.\n" + json.dumps(attribute_stats(dataset, names), ensure_ascii=False)


def styles(answer: str) -> list:
    """The JSON array in a model's answer, with or without code fences; [] where there is none."""
    text = re.sub(r"```(?:json)?", "", answer)
    for m in re.finditer(r"\[", text):
        try:
            got, _ = json.JSONDecoder().raw_decode(text[m.start() :])
        except ValueError:
            continue
        if isinstance(got, list):
            return got
    return []


def suggest_styles(dataset: str, model: Callable[[str], str], names: list[str] | None = None) -> list:
    """Styles from a model given as a function of the prompt; any failure gives []."""
    try:
        return styles(model(style_prompt(dataset, names)))
    except Exception:  # noqa: BLE001  the answer is optional
        return []


class TileServer:
    """Tiles of a dataset: from memory, then from disk, then made and kept in both."""

    def __init__(self, spark: SparkSession, dataset: str, cache_size: int = 256, cap: int = 25_000):
        self.spark, self.dataset, self.size, self.cap = spark, str(dataset), cache_size, cap
        self.held: OrderedDict[tuple[int, int, int], bytes] = OrderedDict()

    def tile(self, z: int, x: int, y: int) -> bytes:
        key = (z, x, y)
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        path = files.join(self.dataset, "mvt", str(z), str(x), f"{y}.mvt")
        data = files.read_bytes(path) if files.exists(path) else self._make(z, x, y, path)
        self.held[key] = data
        if len(self.held) > self.size:
            self.held.popitem(last=False)
        return data

    def _make(self, z: int, x: int, y: int, path: str) -> bytes:
        from terrazzo.functions import mvt

        b = mvt.tile_lonlat(z, x, y)
        found = read_tiles(self.spark, self.dataset, Box(*b))
        inner = [c for c in found.columns if c not in ("geometry", "bbox", "geom_type", "n_points", "partition_id")]
        props = F.to_json(F.struct(*inner)) if inner else F.lit("{}")
        rows = found.select("geometry", props.alias("p")).orderBy(F.xxhash64("geometry", "p")).limit(self.cap).collect()  # as many features as a rendered tile has at most
        data = mvt.render(z, x, y, [(bytes(r["geometry"]), json.loads(r["p"])) for r in rows], simplify=False, pad=0)
        files.write_bytes(path, data)
        return data
