"""Datasets as folders: listing, search, sizes and introspection."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

_UNITS = {"b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40}


def parse_size(text: str | int) -> int:
    """Bytes of a size such as 512mb or 1.5GB; units are powers of 1024, none means bytes."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?b)?\s*", str(text).lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * _UNITS[m[2] or "b"])


def format_size(n: int) -> str:
    for unit in ("GB", "MB"):
        if n >= _UNITS[unit.lower()]:
            return f"{n / _UNITS[unit.lower()]:.1f} {unit}"
    return f"{n / 1024:.1f} KB"


def name_matches(name: Column, q: str) -> Column:
    return F.contains(F.lower(name), F.lit(q.lower()))


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def datasets(spark: SparkSession, root: str, q: str = "") -> DataFrame:
    """id, name, size and file_count of the datasets under root whose name holds q, by id."""
    rows = []
    for d in files.listing(root):
        if d.type == fs.FileType.Directory:
            held = [f for f in files.listing(files.join(root, d.base_name), deep=True) if f.is_file]
            rows.append((d.base_name, sum(f.size for f in held), len(held)))
    df = spark.createDataFrame(rows, "id string, size bigint, file_count int")
    return df.where(name_matches(F.col("id"), q)).select("id", display_name(F.col("id")).alias("name"), "size", "file_count").orderBy("id")


@dataclass
class Dataset:
    """A dataset folder, a path or a URI: parquet_tiles/, histograms/, mvt/ and stats/."""

    path: str

    def __post_init__(self):
        self.path = str(self.path)
        if files.kind(self.path) != "folder":
            raise FileNotFoundError(self.path)

    def _held(self, part: str) -> list[fs.FileInfo]:
        return files.listing(files.join(self.path, part))

    @property
    def num_tiles(self) -> int:
        return sum(f.base_name.endswith(".parquet") for f in self._held("parquet_tiles"))

    @property
    def manifest(self) -> list[dict]:
        f = files.join(self.path, "manifest.json")
        return json.loads(files.read_text(f)) if files.exists(f) else []

    def partition_box(self, tile_id: int | str) -> tuple[float, float, float, float] | None:
        """The box of a partition by its number, as 7, "7" or "tile_000007"; None for one that does not exist or has no geometry."""
        m = re.fullmatch(r"(?:tile_)?(\d+).*", str(tile_id))
        found = [x for x in self.manifest if m and x["partition_id"] == int(m[1]) and x["xmin"] is not None]
        return tuple(found[0][c] for c in ("xmin", "ymin", "xmax", "ymax")) if found else None

    @property
    def bbox(self) -> tuple[float, float, float, float] | None:
        boxes = [m for m in self.manifest if m["xmin"] is not None]
        return (min(m["xmin"] for m in boxes), min(m["ymin"] for m in boxes), max(m["xmax"] for m in boxes), max(m["ymax"] for m in boxes)) if boxes else None

    @property
    def zoom_levels(self) -> list[int]:
        return sorted(int(f.base_name) for f in self._held("mvt") if f.base_name.isdigit())

    @property
    def has_histograms(self) -> bool:
        return bool(self._held("histograms"))

    @property
    def has_mvt(self) -> bool:
        return bool(self.zoom_levels)

    @property
    def has_stats(self) -> bool:
        return files.exists(files.join(self.path, "stats", "attributes.json"))

    @property
    def size(self) -> int:
        return sum(f.size for f in files.listing(self.path, deep=True) if f.is_file)
