"""Tables that outlive a job, block-to-shard exchanges and small helpers shared by the operators."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
MOST_BITS = 1 << 24  # of a sieve: 262,144 rows of 64 bits on every executor


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset: a local folder on a single machine, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "terrazzo-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_tables: list[str] = []  # folders that stored() made and nobody has deleted


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._terrazzo_path = path
    return made


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _tables.remove(path)


def remove(*tables: DataFrame | None) -> None:
    """Deletes tables made by stored() that are no longer read."""
    for df in tables:
        path = getattr(df, "_terrazzo_path", None)
        if path in _tables:
            _delete(df.sparkSession, [path])


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that were stored inside it; call its value with those to keep."""
    before, kept = set(_tables), []
    try:
        yield kept.append
    finally:
        keep = {getattr(df, "_terrazzo_path", None) for df in kept}
        _delete(spark, [p for p in _tables if p not in before and p not in keep])


def remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(spark: SparkSession, size: int, target: int) -> int:
    """How many parts keep one near `target` bytes; follows the input without bound."""
    return max(partitions(spark), -(-int(size) // target))


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.select(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)


def sieved(rows: DataFrame, column: str, wanted: DataFrame, key: str, into: str = "__may") -> DataFrame:
    """Adds whether an id of rows may stand in wanted[key]: true where it does, false for most others.

    A bit for each hash goes to every executor, so that rows which a join would drop or leave as they
    are need not be shuffled; the join on the others decides. There are four bits or more for each row of
    wanted up to MOST_BITS in all; beyond that nothing is lost, but more of the others are true.
    """
    bits = min(MOST_BITS, max(64, 4 << wanted.count().bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = wanted.select(at(key).alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__at & 63 as int)))").alias("__bits"))
    found = rows.withColumn("__at", at(column)).join(F.broadcast(words), F.shiftright("__at", 6) == F.col("__word"), "left")
    return found.withColumn(into, F.expr("coalesce(shiftright(__bits, cast(__at & 63 as int)) & 1 = 1, false)")).drop("__at", "__word", "__bits")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of 64-bit keys; in their order where the keys are."""
    return (((keys >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def parts_by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that hold some of the sorted keys, and the bounds of their parts."""
    s = shard_of(keys, shards)
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return s[head], np.append(head, len(s))


def places(keys: np.ndarray, asked: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted keys of the shards `asked` begin and end."""
    s = shard_of(keys, shards)
    return np.searchsorted(s, asked), np.searchsorted(s, asked, "right")


def pack_counts(x: np.ndarray) -> bytes:
    """Non-negative integers: a byte each, 255 marking those listed in full behind them."""
    small = np.minimum(x, 255).astype(np.uint8)
    return small.tobytes() + x[x >= 255].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as gaps, like bytes together: the high bytes are zeros, which compress."""
    gaps = np.diff(keys, prepend=_U(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=_U)


def exchange(
    docs: DataFrame,
    deal: Column,
    blocks: int,
    shards: int,
    request: Callable,
    request_schema: str,
    answer: Callable,
    answer_schema: str,
    finish: Callable,
    finish_schema,
) -> DataFrame:
    """Lets blocks of documents ask sharded tables, with one row for each block and shard that it needs.

    `deal` is hashed to deal the documents to blocks (column __block, one block a task).
    request(table) makes rows (__block, shard, ...) with packed distinct keys of the block;
    answer(table) sees all requests of one shard and makes rows (__block, shard, ...); finish(docs,
    answers) makes the result of a block. A key that many documents hold is a single entry for each
    block, so no task reads the rows of a hot key. Numbers of blocks and shards follow the input, so
    that a task holds a bounded part of it; where there are more shards than a block has keys, the
    rows are as many as the keys.
    """
    dealt = docs.withColumn("__block", F.pmod(F.xxhash64(deal), F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("__block"))
    asked = dealt.groupBy("__block").applyInArrow(request, request_schema).repartitionById(shards, F.col("shard"))
    told = asked.groupBy("shard").applyInArrow(answer, answer_schema).repartitionById(blocks, F.col("__block"))
    return dealt.groupBy("__block").cogroup(told.groupBy("__block")).applyInArrow(finish, finish_schema)
