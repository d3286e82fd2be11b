"""GeoJSON sources: feature collections and one feature a line."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.functions.udfs import from_geojson

SUFFIXES = (".geojson", ".geojsonl", ".json", ".jsonl")
SNIFF = 64 << 10


def is_geojson(path: str) -> bool:
    return path.lower().endswith(SUFFIXES)


def head(spark: SparkSession, path: str) -> str:
    """The first bytes of the first file, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        p = sorted((s.getPath() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))), key=lambda x: x.getName())[0]
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(SNIFF)).decode("utf-8", "replace")
    finally:
        stream.close()


def is_lines(text: str) -> bool:
    """Whether the first line that is not blank is a whole feature."""
    for line in text.splitlines():
        if line.strip():
            try:
                got = json.loads(line)
            except ValueError:
                return False
            return isinstance(got, dict) and got.get("type") == "Feature"
    return False


def crs_hint(text: str) -> str | None:
    """The crs name that a collection states before its features."""
    before = text.split('"features"')[0]
    m = re.search(r'"crs"\s*:\s*\{.*?"name"\s*:\s*"([^"]+)"', before, re.S)
    return m[1] if m else None


def _schema(text: str | None) -> T.StructType:
    """Fields of Spark's name for a variant object's type, such as OBJECT<a: BIGINT, b: STRING>."""
    fields, depth, at = [], 0, 0
    inner = text[7:-1] if text and text.startswith("OBJECT<") else ""
    for i, c in enumerate(inner + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0 and inner[at:i].strip():
            name, kind = inner[at:i].strip().rsplit(": ", 1) if "<" not in inner[at:i] else inner[at:i].strip().split(": ", 1)
            simple = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}
            number = T.DoubleType() if kind.startswith("DECIMAL") else T.StringType()
            fields.append(T.StructField(name.strip("`"), simple.get(kind, number)))
            at = i + 1
    return T.StructType(fields)


def read_geojson(spark: SparkSession, path: str, properties: T.StructType | None = None) -> DataFrame:
    """Properties as columns, then geometry as WKB.

    Without a schema, names and types are those that the properties have in common over the whole
    input (nested ones and those without any value are text; a malformed line raises). With one,
    values are cast to its types, what is missing or does not cast is null, and other properties
    are dropped.
    """
    if is_lines(head(spark, path)):
        lines = spark.read.text(path).where(F.trim("value") != "")
        feature = lines.select(F.parse_json("value").alias("f"))
    else:
        whole = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path)
        feature = whole.select(F.explode(F.expr("cast(variant_get(v, '$.features') as array<variant>)")).alias("f"))
    return features_of(feature, properties)


def features_of(feature: DataFrame, properties: T.StructType | None = None) -> DataFrame:
    """Properties as columns, then geometry as WKB, of features as variants in the column f."""
    rows = feature.select(F.expr("cast(variant_get(f, '$.properties') as map<string, variant>)").alias("p"), F.expr("to_json(variant_get(f, '$.geometry'))").alias("g"))
    if properties is None:
        properties = _schema(feature.agg(F.schema_of_variant_agg(F.expr("variant_get(f, '$.properties')"))).first()[0])
    value = lambda f: F.try_variant_get(F.col("p")[f.name], "$", f.dataType.simpleString()).alias(f.name)
    geometry = from_geojson(F.when(F.col("g") != "null", F.col("g")))
    return rows.select(*(value(f) for f in properties), geometry.alias("geometry"))
