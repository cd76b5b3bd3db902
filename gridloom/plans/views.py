"""Domain views of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("error", "click", "purchase", "signup", "view")
_CODE = " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(TYPES))
_VOX = f"""SELECT event_id AS id, event_id % 20 AS x, CAST(floor(event_id / 20) AS BIGINT) % 20 AS y, CAST(floor(event_id / 400) AS BIGINT) AS z,
  value AS v, CAST(CASE event_type {_CODE} END AS BIGINT) AS label, user_id FROM events"""
#: Common table expressions for the SQL side.
VOX = f"vox AS ({_VOX})"
SERIES = "series AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
CLOUD = "cloud AS (SELECT label AS cloud, vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
BOXES = """boxes AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS x0, p_partkey % 40 AS y0, p_partkey % 25 AS z0,
  p_size + p_size % 7 + 1 AS x1, p_partkey % 40 + p_partkey % 5 + 2 AS y1, p_partkey % 25 + p_partkey % 3 + 1 AS z1 FROM part)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 20).alias("x"),
        (F.expr("event_id div 20") % 20).alias("y"),
        F.expr("event_id div 400").alias("z"),
        F.col("value").alias("v"),
        code.cast("bigint").alias("label"),
        "user_id",
    )


def extent(voxels: DataFrame) -> tuple[int, int, int]:
    """The shape of a volume from 0: one aggregation."""
    low_high = voxels.agg(*[F.min(a) for a in "xyz"], *[F.max(a) for a in "xyz"]).first()
    if any(low is not None and low < 0 for low in low_high[:3]):
        raise ValueError(f"voxels below 0: {tuple(low_high[:3])}")
    return tuple(0 if high is None else high + 1 for high in low_high[3:])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("value").alias("v"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("bigint").alias("t"), F.count("*").over(w).alias("n"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("cloud"), F.col("vec_id").alias("idx"), *[F.get("embedding", F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")])


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"),
        F.col("p_size").cast("bigint").alias("x0"),
        (k % 40).alias("y0"),
        (k % 25).alias("z0"),
        (F.col("p_size") + F.col("p_size") % 7 + 1).cast("bigint").alias("x1"),
        (k % 40 + k % 5 + 2).alias("y1"),
        (k % 25 + k % 3 + 1).alias("z1"),
    )
