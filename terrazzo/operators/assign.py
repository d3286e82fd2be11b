"""Assignment of features to the boxes of a partition index.

The index is a driver list: it has at most MOST boxes, which is checked, and stands in the plan as
an array literal, so assignment is a projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.functions.boxes import EPS, Box, area, clipped, contains, expansion, intersects, is_empty, merged, overlaps

MOST = 20_000
Boxes = Sequence[tuple[int, float, float, float, float]]  # pid, xmin, ymin, xmax, ymax


def _literal(boxes: Boxes) -> Column:
    """The boxes as an array of structs, numbered in the order given."""
    if not boxes:
        raise ValueError("a partition index needs boxes")
    if len(boxes) > MOST:
        raise ValueError(f"a partition index has at most {MOST} boxes")
    rows = ", ".join(f"struct({i}, {int(p)}, {float(a)!r}D, {float(b)!r}D, {float(c)!r}D, {float(d)!r}D)" for i, (p, a, b, c, d) in enumerate(boxes))
    return F.expr(f"cast(array({rows}) as array<struct<idx:int,pid:int,xmin:double,ymin:double,xmax:double,ymax:double>>)")


def box_frame(spark, boxes: Boxes) -> DataFrame:
    """The index as a table: pid, xmin, ymin, xmax, ymax and the place idx."""
    return spark.range(1).select(F.explode(_literal(boxes)).alias("b")).select("b.*")


def partition_of(boxes: Boxes, x: Column, y: Column) -> Column:
    """The partition of a centroid: exactly one for every row.

    Boxes are taken in order of xmin. The window of a centroid runs from the first box, among those
    that begin at or left of it, that does not end left of it. The first box in the window that
    holds the point wins; else the one that grows least (all boxes, if the window is empty), the
    first of equals. A null centroid goes to the smallest box.
    """
    ordered = sorted(boxes, key=lambda b: b[1])
    smallest = min(ordered, key=lambda b: (b[3] - b[1]) * (b[4] - b[2]))[0]
    every = _literal(ordered)
    begun = F.filter(every, lambda b: b["xmin"] <= x)
    first = F.array_min(F.transform(F.filter(begun, lambda b: b["xmax"] >= x), lambda b: b["idx"]))
    window = F.filter(begun, lambda b: b["idx"] >= first)
    point = Box(x, y, x, y)
    grown = lambda b: expansion(Box.of(b), point)
    within = F.array_min(F.transform(window, lambda b: F.when(contains(Box.of(b), point, EPS), F.struct(F.lit(0).alias("o"), F.lit(0.0).alias("e"), b["idx"].alias("i"), b["pid"].alias("p"))).otherwise(F.struct(F.lit(1).alias("o"), grown(b).alias("e"), b["idx"].alias("i"), b["pid"].alias("p")))))
    anywhere = F.array_min(F.transform(every, lambda b: F.struct(grown(b).alias("e"), b["idx"].alias("i"), b["pid"].alias("p"))))
    return F.when(x.isNull() | y.isNull(), F.lit(int(smallest))).when(first.isNull(), anywhere["p"]).otherwise(within["p"]).cast("int")


def assign_partitions(features: DataFrame, boxes: Boxes, x: str = "cx", y: str = "cy", into: str = "partition_id") -> DataFrame:
    return features.withColumn(into, partition_of(boxes, F.col(x), F.col(y)))


def assign_smallest_area(features: DataFrame, boxes: Boxes, box: Box, into: str = "partition_id") -> DataFrame:
    """The smallest box that each feature's box intersects, the first of equals; other features drop out."""
    hits = F.filter(_literal(boxes), lambda b: intersects(Box.of(b), box))
    best = F.array_min(F.transform(hits, lambda b: F.struct(area(Box.of(b)).alias("a"), b["idx"].alias("i"), b["pid"].alias("p"))))
    return features.withColumn(into, best["p"]).where(F.col(into).isNotNull())


def overlapping_partitions(features: DataFrame, boxes: Boxes, box: Box, into: str = "partition_id", place_empty: bool = True) -> DataFrame:
    """One row for each box that overlaps the feature's box (open).

    An empty box goes to the first; without place_empty it is compared like any other, as a join does.
    """
    every = _literal(boxes)
    hits = F.transform(F.filter(every, lambda b: overlaps(Box.of(b), box)), lambda b: b["pid"])
    if place_empty:
        hits = F.when(is_empty(box), F.array(F.element_at(every, 1)["pid"])).otherwise(hits)
    return features.withColumn(into, F.explode(hits))


def best_partition(features: DataFrame, boxes: Boxes, box: Box, bounds: Box, into: str = "partition_id") -> DataFrame:
    """Of the overlapping boxes the one that grows least within `bounds`, then the smaller, then the first."""
    x0, y0, x1, y1 = box.columns()

    def growth(b: Column) -> Column:
        before, after = clipped(bounds, Box.of(b)), clipped(bounds, merged(Box.of(b), box))
        return area(after) - area(before)

    every = _literal(boxes)
    hits = F.filter(every, lambda b: overlaps(Box.of(b), box))
    best = F.array_min(F.transform(hits, lambda b: F.struct(growth(b).alias("g"), area(Box.of(b)).alias("a"), b["idx"].alias("i"), b["pid"].alias("p"))))
    return features.withColumn(into, F.coalesce(best["p"], F.element_at(every, 1)["pid"]))


def point_weights(points: DataFrame, bins: DataFrame, key: str = "bin", value: str = "value") -> DataFrame:
    """Each point's share of its bin's value: value // points in the bin, 0 where the bin has none."""
    n = points.groupBy(key).agg(F.count("*").alias("__n"))
    share = bins.join(n, key).select(F.col(key), F.greatest(F.lit(0), F.floor(F.col(value) / F.col("__n"))).cast("bigint").alias("weight"))
    return points.join(share, key, "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("bigint")))


def cumulative_weight(points: DataFrame, by: str, weight: str = "weight", group: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("cumulative", F.sum(weight).over(w))
