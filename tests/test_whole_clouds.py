"""Point queries ask for every point, and none of their tasks holds a cloud."""

import numpy as np
import pytest

import __spark_entry__ as entry
from gridloom.operators import points as P


@pytest.fixture(scope="module")
def clouds(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clouds"))
    rng = np.random.default_rng(5)
    at = np.round(np.repeat(rng.normal(scale=0.1, size=(60, 3)), 2, axis=0), 3)  # two points a place
    at[7] = at[7] + 9  # far from all others
    spark.createDataFrame([(k, k % 2, [float(v) for v in p]) for k, p in enumerate(at, 1)], "vec_id bigint, label int, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path, {k: (k % 2, p) for k, p in enumerate(at, 1)}


def distances(points):
    return {(c, i, j): float(((p - q) ** 2).sum()) for i, (c, p) in points.items() for j, (d, q) in points.items() if c == d}


def nearest(points, most, within=np.inf):
    out = set()
    for i, (c, _) in points.items():
        near = sorted((d, j) for (_, a, j), d in distances({k: v for k, v in points.items() if v[0] == c}).items() if a == i and d <= within)
        out |= {(c, i, k, j) for k, (_, j) in enumerate(near[:most], 1)}
    return out


def test_sq_distances_of_all_points(spark, clouds, monkeypatch):
    monkeypatch.setattr(P, "PART", 9, raising=False)
    rows = entry.queries()["sq_distances"](spark, clouds[0]).collect()
    assert len(rows) == 2 * 60 * 60
    assert {(r.cloud, r.i, r.j): r.d2 for r in rows} == pytest.approx(distances(clouds[1]), abs=2e-6)


def test_knn_of_all_points(spark, clouds):
    rows = entry.queries()["knn"](spark, clouds[0]).collect()
    assert {(r.cloud, r.i, r.rank, r.j) for r in rows} == nearest(clouds[1], 4) and len(rows) == 120 * 4


def test_ball_query_of_all_points(spark, clouds):
    rows = entry.queries()["ball_query"](spark, clouds[0]).collect()
    assert {(r.cloud, r.i, r.rank, r.j) for r in rows} == nearest(clouds[1], 5, 0.01)
    assert len(rows) > 120 and 1 in {sum(r.i == i for r in rows) for i in range(1, 121)}
