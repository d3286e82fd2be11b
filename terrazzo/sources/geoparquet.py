"""GeoParquet: reading features, and writing one file for each spatial partition."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions.boxes import Box
from terrazzo.operators.assign import Boxes

from . import files
from .geojson import is_geojson, read_geojson


def read_features(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Features of a GeoJSON or GeoParquet path (folders are searched at any depth)."""
    if is_geojson(path):
        return read_geojson(spark, path).withColumnRenamed("geometry", geometry)
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def read_index(spark: SparkSession, path: str) -> list[tuple]:
    """A partition index from a CSV file with the columns id, minx, miny, maxx, maxy."""
    df = spark.read.option("header", True).csv(path)
    names = ["id", "minx", "miny", "maxx", "maxy"]
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"the index lacks {', '.join(missing)}")
    return [(int(r[0]), *map(float, r[1:])) for r in df.select(names).collect()]  # an index is small; assign checks its size


def index_frame(spark: SparkSession, boxes: Boxes) -> DataFrame:
    return spark.createDataFrame([(int(p), *map(float, b)) for p, *b in boxes], "id int, minx double, miny double, maxx double, maxy double")


def geo_footer(geometry: str, box: tuple | None, crs: str | None = None) -> bytes:
    """The `geo` metadata: version, primary column, WKB encoding, and the box."""
    column = {"encoding": "WKB", "geometry_types": []} | ({"crs": crs} if crs else {}) | ({"bbox": list(box)} if box else {})
    return json.dumps({"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}} | ({"bbox": list(box)} if box else {})).encode()


def file_name(number: int, box: tuple | None) -> str:
    return f"tile_{number:06d}__" + "_".join(f"{v:.6f}" for v in box or (0, 0, 0, 0)).replace(".", "_") + ".parquet"


MANIFEST = "partition_id int, file string, n_rows bigint, xmin double, ymin double, xmax double, ymax double"


def write_tiles(features: DataFrame, folder: str, order: list, geometry: str = "geometry", compression: str = "zstd", partition: str = "partition_id", crs: str | None = None) -> list[dict]:
    """Writes a file for each partition, sorted by `order`, and returns the manifest.

    Rows stream from the sorted shuffle into the file, so a task holds a batch at a time. A file
    gets its name when it is complete, so a task that runs twice leaves one file. Columns whose
    name begins with two underscores order rows and are not written.
    """
    hidden = [c for c in features.columns if c.startswith("__")]
    schema = features.drop(partition, *hidden).limit(0).toArrow().schema

    def run(batches):
        store, root = files.store(folder)
        store.create_dir(root, recursive=True)
        state: dict = {}

        def close():
            if not state:
                return None
            box = tuple(state["box"]) if state["box"] else None
            state["writer"].add_key_value_metadata({"geo": geo_footer(geometry, box, crs)})
            state["writer"].close()
            name = file_name(state["pid"], box)
            store.move(state["temp"], f"{root}/{name}")
            row = (state["pid"], name, state["rows"], *(box or (None,) * 4))
            state.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), *[pa.float64()] * 4))], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            pids = batch.column(batch.schema.get_field_index(partition)).to_pylist()
            boxes = batch.column(batch.schema.get_field_index("bbox")).to_pylist()
            data = batch.drop_columns([partition, *hidden])
            at = 0
            while at < len(pids):
                to = at
                while to < len(pids) and pids[to] == pids[at]:
                    to += 1
                if state and state["pid"] != pids[at]:
                    yield close()
                if not state:
                    temp = f"{root}/.{uuid.uuid4().hex}.part"
                    state.update(pid=pids[at], temp=temp, rows=0, box=None, writer=pq.ParquetWriter(temp, schema, compression=compression, filesystem=store))
                state["writer"].write_batch(pa.RecordBatch.from_arrays(data.slice(at, to - at).columns, schema=schema))
                state["rows"] += to - at
                for b in boxes[at:to]:
                    if b and b["xmin"] is not None:
                        o = state["box"]
                        state["box"] = [b["xmin"], b["ymin"], b["xmax"], b["ymax"]] if o is None else [min(o[0], b["xmin"]), min(o[1], b["ymin"]), max(o[2], b["xmax"]), max(o[3], b["ymax"])]
                at = to
        if state:
            yield close()

    dealt = features.repartition(F.col(partition)).sortWithinPartitions(partition, *order)
    return [r.asDict() for r in dealt.select(*features.columns).mapInArrow(run, MANIFEST).orderBy(partition).collect()]  # a row for each file

