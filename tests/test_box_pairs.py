"""Intersections of boxes as pairs of ids, copies included."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.operators import boxes as B

COLS = [f"{a}{e}" for a in "xyz" for e in (0, 1)]


def test_all_pairs_of_boxes(spark, monkeypatch):
    monkeypatch.setattr(B, "MEMBERS", 5)
    rows = [(k % 58, k % 3, k % 3 + 2, 0, 2, k % 2 * 3, k % 2 * 3 + 1) for k in range(60)] + [(60, 5, 5, 0, 1, 0, 1), (61, None, 3, 0, 1, 0, 1)]
    boxes = spark.createDataFrame(rows, "id bigint, x0 bigint, x1 bigint, y0 bigint, y1 bigint, z0 bigint, z1 bigint")
    usable = boxes.where(F.col("x0") < F.col("x1"))
    want = sorted(map(tuple, B.intersections(usable, usable, (2, 2, 2)).select("id_a", "id_b", *COLS).collect()))
    assert sorted(map(tuple, B.pair_intersections(boxes, (2, 2, 2)).select("id_a", "id_b", *COLS).collect())) == want


def test_the_query_has_copies_of_a_box_as_pairs(spark, tmp_path):
    spark.createDataFrame([(k * 600, 7) for k in range(1, 7)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()["box_intersections"](spark, str(tmp_path)).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == [(a * 600, b * 600) for a in range(1, 7) for b in range(1, 7)]
