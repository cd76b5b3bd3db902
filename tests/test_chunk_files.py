"""Chunk tables are stored in as many files as tasks write, not as the volume has planes of chunks."""

from pathlib import Path

from pyspark.sql import functions as F

from gridloom.sources import volumes as store


def test_files_do_not_grow_with_depth(spark, tmp_path):
    n = 64
    df = spark.range(4 * n).select((F.col("id") % 2).alias("x"), F.expr("id div 2 % 2").alias("y"), F.expr("id div 4").alias("z"), F.col("id").cast("double").alias("v"))
    path = str(tmp_path / "chunks")
    store.write_chunks(store.to_chunks(df, (2, 2, 1)), path)
    assert len(list(Path(path).rglob("*.parquet"))) <= 8  # before: a folder and a file for each of 64 planes
    store.write_chunks(store.to_chunks(df, (2, 2, 1)), path, resume=True)  # nothing is missing
    got = store.read_range(spark.read.parquet(path), (2, 2, 1), (0, 1, 5), (2, 2, 9)).collect()
    assert sorted((r["x"], r["y"], r["z"], r["v"]) for r in got) == [(x, 1, z, float(4 * z + 2 + x)) for x in range(2) for z in range(5, 9)]
