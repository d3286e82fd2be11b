import os

import pytest
from pyspark.sql import functions as F

from terrazzo.functions.boxes import Box
from terrazzo.operators import assign
from terrazzo.plans.queries import ORACLES, QUERIES
from terrazzo.plans.views import BOXES
from tests.oracle import canonical, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(rows(ORACLES[name], SF))


@pytest.mark.parametrize("name", ["overlap_partitions", "overlap_best", "assign_smallest_area"])
def test_boxes_that_the_map_edge_turns_over_equal_sql(spark, tmp_path, name):
    """Clamped to +-179.9, the boxes of suppliers 3605, 49679 and 53284 end before they begin."""
    for table in os.listdir(SF):
        if table != "supplier.parquet":
            os.symlink(f"{SF}/{table}", tmp_path / table)
    given = spark.read.parquet(f"{SF}/supplier.parquet")
    key = F.element_at(F.array(*map(F.lit, (0, 1, 3605, 49679, 53284, 42))), (F.col("s_suppkey") + 1).cast("int")).cast("bigint")
    given.where("s_suppkey < 6").withColumn("s_suppkey", key).write.parquet(f"{tmp_path}/supplier.parquet")
    assert canonical(QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(rows(ORACLES[name], str(tmp_path)))


def test_an_empty_box_goes_to_the_first(spark):
    given = spark.createDataFrame([(1, 5.0, 0.0, 4.0, 1.0), (2, -65.0, -5.0, -64.0, -4.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    placed = {way: [tuple(r) for r in assign.overlapping_partitions(given, BOXES, Box.named(), place_empty=way).select("id", "partition_id").collect()] for way in (True, False)}
    assert placed == {True: [(1, 0), (2, 0)], False: [(1, 3), (2, 0)]}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_assignment_needs_no_shuffle_or_join(spark):
    plan = QUERIES["assign_partition"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
