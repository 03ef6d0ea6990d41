"""Written tables compress well, which must not make Spark gather them on the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import ordered


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(0, 1_500_000, 1, 4).select((F.col("id") / 30).cast("long").alias("pid"), (F.col("id") % 30).alias("day"), F.lit("f").alias("feature"), F.lit(1.0).alias("value"))
    large, other = ordered.cut(rows), ordered.cut(spark.range(0, 3_000_000, 1, 4).select((F.col("id") * 7919 % 50_000).alias("pid"), F.hash("id").alias("x")))
    return large, other, ordered.cut(spark.range(100).select(F.col("id").alias("pid")))


def test_a_large_table_is_not_broadcast_for_its_small_files(tables):
    large, other, _ = tables
    files = int(str(large._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert files < 10 << 20  # what Spark goes by
    for joined in (other.join(large, "pid"), other.join(large.select("pid", "value").where("day > 3"), "pid"), other.join(large.groupBy("pid", "day").agg(F.sum("value").alias("value")), "pid", "left")):
        assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)
    assert other.join(large.where("day = 0"), "pid").count() == 3_000_000


def test_small_tables_and_stated_broadcasts_stay(tables):
    large, _, small = tables
    assert "BroadcastHashJoin" in plan(large.join(small, "pid"))
    assert "BroadcastHashJoin" in plan(small.join(F.broadcast(large.groupBy("pid").agg(F.sum("value").alias("value"))), "pid"))
    assert "BroadcastHashJoin" in plan(large.join(F.broadcast(small), "pid"))
