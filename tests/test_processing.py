"""Proximity graphs, internal objects, small files and subvolumes against plain versions."""

import itertools
import math
import random
import zipfile

import numpy as np
import pytest

from gridloom.operators import filters as N
from gridloom.operators import proximity as P
from gridloom.operators import subvolumes as U
from gridloom.operators import trees as G
from gridloom.sources import shared, tables


def tree(points):
    """The minimum spanning tree of segments by their closest points."""
    best = {}
    for (s, i, p), (t, j, q) in itertools.combinations(sorted(points), 2):
        if s != t:
            found = (sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), i, j)
            best[s, t] = min(best.get((s, t), found), found)
    part = {s: s for s, _, _ in points}
    out = []
    for (d2, i, j), (s, t) in sorted((v, k) for k, v in best.items()):
        if part[s] != part[t]:
            out.append((s, t, i, j, round(d2, 9)))
            old, new = part[s], part[t]
            part = {k: new if v == old else v for k, v in part.items()}
    return sorted(out)


@pytest.mark.parametrize("radius", [0.05, 0.4, 5.0])
def test_segment_graph(spark, radius):
    rng = random.Random(3)
    points = [(s, 100 * s + k, tuple(rng.gauss(m, 0.3) for m in (s % 4, s // 4, 0))) for s in range(9) for k in range(rng.randint(1, 6))]
    df = spark.createDataFrame([(s, i, *p) for s, i, p in points], "segment bigint, idx bigint, x double, y double, z double")
    got = sorted((r["a"], r["b"], r["ia"], r["ib"], round(r["d2"], 9)) for r in P.segment_graph(df, radius).collect())
    assert got == tree(points)
    assert P.segment_graph(df.limit(0), radius).count() == 0
    assert P.segment_graph(df.where("segment = 0"), radius).count() == 0


def test_internal_objects(spark):
    # a ring 1-2-3 with 4 hanging off 3, and 5 and 6 in a chain off 2
    edges = [(0, 1, 2), (0, 2, 3), (0, 1, 3), (0, 3, 4), (0, 2, 5), (0, 5, 6), (1, 7, 8)]
    parts = G.biconnected(spark.createDataFrame(edges, "graph int, a bigint, b bigint"))
    number = {(r["graph"], r["a"], r["b"]): r["component"] for r in parts.collect()}
    outer = spark.createDataFrame([(0, 1)], "graph int, node bigint")
    got = {(r["graph"], r["component"]): r["target"] for r in G.internal_objects(parts, outer).collect()}
    assert got[0, number[0, 3, 4]] == 3
    assert got[0, number[0, 5, 6]] == 2 and got[0, number[0, 2, 5]] == 2  # 5 is within 2, so 6 is too
    assert not any(g == 1 for g, _ in got) and (0, number[0, 1, 2]) not in got  # a single edge has no joint; the ring is outside
    alone = G.internal_objects(parts).where("graph = 0").collect()
    assert len(alone) == 4 and {r["target"] for r in alone} == {2}  # without an outside all fall into the least joint


def test_biconnected_of_a_long_chain_of_triangles(spark):
    edges = [(0, 2 * k + i, 2 * k + j) for k in range(300) for i, j in ((0, 1), (1, 2), (0, 2))]
    found = G.biconnected(spark.createDataFrame(edges, "graph int, a bigint, b bigint"))
    assert found.groupBy("component").count().where("count = 3").count() == 300


def test_small_files(spark, tmp_path):
    (tmp_path / "map").write_text("# old,new\n1,10\n2, 20\n")
    (tmp_path / "list").write_text("# objects\n5\n7 8,5\n\n")
    assert {tuple(r) for r in tables.read_relabel_map(spark, str(tmp_path / "map")).collect()} == {(1, 10), (2, 20)}
    assert sorted(r[0] for r in tables.read_object_list(spark, str(tmp_path / "list")).collect()) == [5, 7, 8]
    value = {"a": [1, {"b/c": "d"}], "e": None}
    tables.write_json(spark, value, str(tmp_path / "j"))
    assert tables.read_json(spark, str(tmp_path / "j")) == value and tables.read_json(spark, str(tmp_path / "j"), "/a/1/b~1c") == "d"


def test_zipped_embeddings(spark, tmp_path):
    ids, want = [3, 4, 11, 12], set()
    for s in range(5):
        with zipfile.ZipFile(tmp_path / f"{s}.zip", "w") as z:
            for i in ids:
                if tables.md5_shard(i, 5) == s:
                    z.writestr(f"{i}.csv", "\n".join(f"{k},{i}.5,{k},2,{k}.25,7" for k in range(3)))
                    want |= {(i, i + 0.5, float(k), 2.0, k + 0.25, 7.0) for k in range(3) if i != 12}
    got = tables.read_zipped_embeddings(spark, str(tmp_path), [3, 4, 11, 99], 5).collect() if tables.md5_shard(99, 5) < 5 else []
    assert {(r["id"], r["x"], r["y"], r["z"], *r["vector"]) for r in got} == want
    assert tables.read_zipped_embeddings(spark, str(tmp_path), [], 5).count() == 0


def test_blocks_must_keep_their_shape(spark):
    rng = np.random.default_rng(1)
    block = rng.random((7, 5, 4))
    df = spark.createDataFrame([(x, y, z, float(block[x, y, z])) for x, y, z in np.ndindex(*block.shape)], "x bigint, y bigint, z bigint, v double")
    got = {(r["x"], r["y"], r["z"]): r["v"] for r in U.process(df, (3, 3, 3), (1, 0, 0), lambda b: 2 * b).collect()}
    assert got == {k: 2 * float(block[k]) for k in np.ndindex(*block.shape)}
    with pytest.raises(Exception, match="became one of"):
        U.process(df, (3, 3, 3), (0, 0, 0), lambda b: b[1:]).collect()
    with pytest.raises(ValueError):
        U.stored_pyramid(df, [{"x": 2}, {"x": 3}], lambda d, f: d, shared.shared_path(spark, "t"), (3, 3, 3))


def test_gaussian_weights():
    w = N.gaussian_weights(1.5)
    assert math.isclose(w[0] + 2 * sum(w[1:]), 1) and len(w) == 7 and N.disk(2) == {-2: 0, -1: 1, 0: 2, 1: 1, 2: 0}
