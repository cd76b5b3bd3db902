"""Supervoxels that first appear at one place are numbered by label, the same in each use."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import graphs as G


@pytest.fixture
def spread(spark):
    """Labels come from several tasks, as in large tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_labels_at_one_place(spread):
    spark = spread
    blocks = G.Blocks((1, 1, 1), (4, 4, 4))
    vox = spark.createDataFrame([(k % 2, 0, 0, 1 + (k * 37) % 101) for k in range(202)], "x int, y int, z int, label bigint")
    ids = G.supervoxel_ids(vox, blocks)
    assert [r.sv for r in ids.orderBy("rank").collect()] == list(range(1, 102))
    edges = spark.createDataFrame([(a, a + 1, 1.0) for a in range(1, 101)], "a bigint, b bigint, score double")
    named = {r.sv: r.pcg_id for r in ids.collect()}
    for r in G.block_edges(ids, edges, blocks).where(F.col("class") == "in").collect():
        assert (r.id1, r.id2) == (named[r.a], named[r.b])
