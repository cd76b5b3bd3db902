"""Volumes of another depth than the SQL's 25 planes."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.operators import graphs as G
from gridloom.plans.views import TYPES

PLANES = 42  # 11 blocks along z: more than 7, and more than 3 bits hold


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    """Each voxel's user is its plane and 10000, so a label lies in the 20 blocks of one layer."""
    ts = datetime.datetime(2024, 1, 1)
    rows = [(i, ts, 10000 + i // 400, TYPES[0], 1.0) for i in range(400 * PLANES)]
    out = str(tmp_path_factory.mktemp("deep"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{out}/events.parquet")
    spark.createDataFrame([(1, 0, 1, 1.0)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double").write.parquet(f"{out}/lineitem.parquet")
    return out


def test_blocks_follow_the_volume(spark, path):
    ids = entry.queries()["graph_pcg_ids"](spark, path).collect()
    assert len({r["pcg_id"] for r in ids}) == len(ids) == 20 * PLANES
    assert {r["pcg_id"] for r in ids} == {
        (1 << 56) + (r["block"] % 4 << 52) + (r["block"] // 4 % 5 << 48) + (r["block"] // 20 << 44) + r["rank"] for r in ids
    }
    grid = list(itertools.product(range(4), range(5), range(11)))
    place = lambda c: c[0] + 4 * (c[1] + 5 * c[2])
    near = {(place(a), place(b), sum(i != j for i, j in zip(a, b, strict=True))) for a in grid for b in grid if all(abs(i - j) <= 1 for i, j in zip(a, b, strict=True))}
    got = entry.queries()["graph_block_neighbours"](spark, path).collect()
    assert len(got) == len(near)
    assert {tuple(r) for r in got} == near
    cross = {(r["id1"], r["id2"]) for r in entry.queries()["graph_block_edges"](spark, path).where("class = 'cross'").collect()}
    by_block = {(r["block"], r["sv"]): r["pcg_id"] for r in ids}
    assert cross == {(p, by_block[b, sv]) for (a, sv), p in by_block.items() for x, b, steps in near if x == a and steps and (b, sv) in by_block}


def test_faces_follow_the_volume(spark, path):
    mask = entry.queries()["boundary_mask"](spark, path).collect()
    assert all(r["mask"] == (2 <= r["x"] < 19 and r["y"] < 17 and 1 <= r["z"] < PLANES - 1) for r in mask)
    from gridloom.operators.segmentation import border_ids
    from gridloom.plans.views import extent, vox

    voxels = vox(spark, path).withColumn("label", F.col("id"))
    assert extent(voxels) == (20, 20, PLANES)
    faces = {r["label"] for r in border_ids(voxels, extent(voxels)).collect()}
    assert 400 * 24 + 210 not in faces and 400 * (PLANES - 1) + 210 in faces


def test_border_ids_query(spark, tmp_path):
    ts = datetime.datetime(2024, 1, 1)  # one user a voxel off the faces, user 0 elsewhere
    rows = [(400 * z + 210, ts, z, TYPES[0], 1.0) for z in range(30)] + [(400 * z + 399, ts, 99, TYPES[0], 1.0) for z in range(30)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["label"] for r in entry.queries()["border_ids"](spark, str(tmp_path)).collect()} == {0, 29, 99}
    assert {r["label"] for r in entry.queries()["border_ids_in_plane"](spark, str(tmp_path)).collect()} == {99}


def test_voxels_outside_the_grid_are_an_error(spark):
    df = spark.createDataFrame([(0, 0, 8, 1)], "x bigint, y bigint, z bigint, label bigint")
    with pytest.raises(Exception, match="outside the grid"):
        G.supervoxel_ids(df, G.Blocks((2, 2, 2), (4, 4, 4))).collect()
    assert G.Blocks.covering((20, 20, 25), (5, 4, 4)).shape == (4, 5, 7)
