"""Features that keep arriving in a folder, assigned to a fixed partition index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from terrazzo.operators.assign import Boxes, assign_partitions


def stream_assigned(spark: SparkSession, folder: str, schema: T.StructType, boxes: Boxes, x: str = "cx", y: str = "cy", files_per_trigger: int = 64) -> DataFrame:
    """A stream of the folder's Parquet rows with their partition; row by row, so without state or watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return assign_partitions(rows, boxes, x, y)


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to Parquet by partition; the file sink's log makes it exactly once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("partition_id").outputMode("append").trigger(availableNow=True).start(out)
