"""Statistics of every column, by its type, in one aggregation over the table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP, SHARE = 20, 0.8
LG_K = 12  # 4,096 registers


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
        return "numeric"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "text" if isinstance(kind, T.StringType) else "categorical"


def approx_distinct(c: Column) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LG_K))), F.lit(0).cast("bigint"))


def column_aggregates(name: str, kind: T.DataType, sketch: bool = True) -> dict[str, Column]:
    """Aggregates of one column by name; nulls never count, nor do NaNs of numeric columns."""
    c, sort = F.col(f"`{name}`"), kind_of(kind)
    if sort in ("numeric", "time"):
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        number = c.cast("timestamp").cast("double") if sort == "time" else c.cast("double")
        out = {"non_null_count": F.count(c), "min": F.min(c), "max": F.max(c), "mean": F.coalesce(F.avg(number), F.lit(0.0)), "stddev": F.coalesce(F.stddev_pop(number), F.lit(0.0))}
    else:
        out = {"non_null_count": F.count(c)}
        if sort == "text":
            out |= {"avg_length": F.coalesce(F.avg(F.length(c)), F.lit(0.0)), "min_length": F.coalesce(F.min(F.length(c)), F.lit(0)), "max_length": F.coalesce(F.max(F.length(c)), F.lit(0))}
    return out | ({"approx_distinct": approx_distinct(_text(c, kind))} if sketch else {})


def top_values(df: DataFrame, name: str, k: int = TOP, share: float = SHARE) -> DataFrame:
    """The k commonest values (value, count) of a column, or no row if they make up less than `share`."""
    c = F.col(f"`{name}`")
    counts = df.where(c.isNotNull()).groupBy(_text(c, df.schema[name].dataType).alias("value")).agg(F.count("*").alias("count"))
    top = counts.orderBy(F.col("count").desc(), "value").limit(k)
    total = counts.agg(F.sum("count").alias("__all")).crossJoin(top.agg(F.sum("count").alias("__top")))  # one row
    return top.crossJoin(total).where(F.col("__top") >= F.lit(share) * F.col("__all")).select("value", "count")


def collect_stats(df: DataFrame, geometry: str | None = None) -> list[dict]:
    """The statistics document of all columns, as a list of {name, stats}; one pass plus one for each top list."""
    names = [f.name for f in df.schema if f.name != geometry]
    aggs = {f"{i}:{k}": a for i, n in enumerate(names) for k, a in column_aggregates(n, df.schema[n].dataType).items()}
    row = df.agg(*(a.alias(k) for k, a in aggs.items())).first().asDict() if aggs else {}
    out = []
    for i, n in enumerate(names):
        stats = {k.split(":", 1)[1]: v for k, v in row.items() if k.startswith(f"{i}:")}
        stats["top_k"] = [{"value": r["value"], "count": r["count"]} for r in top_values(df, n).collect()]
        out.append({"name": n, "stats": stats})
    return out


def geometry_stats(features: DataFrame, kind: str = "geom_type", points: str = "n_points", box: str = "bbox") -> DataFrame:
    """One row: the box of all features, the count of each type, and the vertices of points and lines."""
    b = F.col(box)
    kept = features.where(b["xmin"].isNotNull())
    by = kept.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.when(F.col(kind).isin("Point", "LineString", "LinearRing"), F.col(points)).otherwise(0)).alias("p"), *(f(b[c]).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))))
    return by.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("geom_types"), F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("total_points"))


def stats_json(stats: list[dict]) -> str:
    return json.dumps({"attributes": stats}, default=str, ensure_ascii=False)
