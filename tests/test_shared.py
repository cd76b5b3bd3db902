"""Intermediate tables that are small as files and large as rows."""

from pyspark.sql import functions as F

from gridloom.sources.shared import BROADCAST_ROWS, materialized


def _joins(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_of_many_rows_is_not_broadcast(spark):
    many = materialized(spark.range(BROADCAST_ROWS + 1).select(F.col("id").alias("a"), F.lit(0).alias("v")), "many")
    more = materialized(spark.range(BROADCAST_ROWS * 2).select(F.col("id").alias("a"), F.lit(1).alias("w")), "more")
    plan = _joins(many.join(more.where("a >= 0").groupBy("a").agg(F.sum("w").alias("w")), "a").agg(F.sum("w")))
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_a_small_or_empty_table_may_be(spark):
    few = materialized(spark.range(10).select(F.col("id").alias("a")), "few")
    other = materialized(spark.range(20).select(F.col("id").alias("a")), "other")
    assert "BroadcastHashJoin" in _joins(few.join(other, "a"))
    assert materialized(few.where("a < 0"), "none").count() == 0
    assert materialized(spark.createDataFrame([], "a bigint"), "empty").isEmpty()


def test_tables_with_a_row_a_voxel_are_not_broadcast(spark):
    from gridloom.operators.segmentation import filtered_mask

    vox = spark.range(60).selectExpr("id", "id % 5 AS x", "id div 5 % 4 AS y", "id div 20 AS z", "id % 2 AS label")
    plan = filtered_mask(vox, "area > 0", {"x": 1})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2
