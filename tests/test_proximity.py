"""Neighbours by widening cells against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import points as Q
from gridloom.operators import proximity as P

SCHEMA = "cloud int, idx bigint, x double, y double, z double"


def clouds(rng):
    """A uniform, a clustered, a flat, a repeated and a tiny cloud."""
    out = {0: rng.random((60, 3)), 1: np.concatenate([rng.normal(0, 0.01, (40, 3)), rng.normal(9, 0.01, (30, 3)), [[100.0, 0, 0]]])}
    out[2] = np.column_stack([rng.integers(0, 6, (50, 2)), np.zeros(50)]).astype(float)
    out[3] = np.concatenate([np.ones((45, 3)), rng.random((5, 3))])
    out[4] = rng.random((2, 3))
    return out


@pytest.mark.parametrize("k", [4])
def test_knn(spark, k):
    rng = np.random.default_rng(k)
    made = clouds(rng)
    rows = [(c, 1000 * c + i, *map(float, p)) for c, x in made.items() for i, p in enumerate(x)]
    df = spark.createDataFrame([*rows, (5, 1, None, 0.0, 0.0), (5, 2, float("nan"), 0.0, 0.0), (None, 3, 0.0, 0.0, 0.0)], SCHEMA)
    got = {}
    for r in Q.knn(df, k).collect():
        got.setdefault((r["cloud"], r["i"]), {})[r["rank"]] = (r["d2"], r["j"])
    for c, i, *p in rows:
        d = sorted((sum((a - b) ** 2 for a, b in zip(p, q[2:])), q[1]) for q in rows if q[0] == c)[:k]
        mine = [got[c, i][n] for n in range(1, len(d) + 1)]
        assert [j for _, j in mine] == [j for _, j in d] and np.allclose([v for v, _ in mine], [v for v, _ in d]), (c, i)
    assert len(got) == len(rows) and Q.knn(df.limit(0), k).collect() == []


def test_farthest(spark):
    made = clouds(np.random.default_rng(3))
    rows = [(c, i, *map(float, p)) for c, x in made.items() for i, p in enumerate(x)]
    got = {(r["cloud"], r["i"]): r["d2"] for r in P.farthest(spark.createDataFrame(rows, SCHEMA), few=9).collect()}
    for c, i, *p in rows:
        assert math.isclose(got[c, i], max(sum((a - b) ** 2 for a, b in zip(p, q)) for q in made[c]), abs_tol=1e-12)


@pytest.mark.parametrize("radius", [0.3])
def test_segment_graph_of_far_parts(spark, radius):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(14):
        middle = rng.integers(0, 30, 3) * (1 if s % 2 else 5)
        rows += [(s, 100 * s + k, *map(float, middle + rng.normal(0, 0.2 + s % 3, 3))) for k in range(1 + 9 * (s % 4))]
    rows += [(0, 9000 + k, *rows[0][2:]) for k in range(5)]  # copies of a point
    df = spark.createDataFrame([*rows, (50, 1, None, 1.0, 1.0), (51, 2, float("nan"), 1.0, 1.0), (None, 3, 1.0, 1.0, 1.0)], "segment bigint, idx bigint, x double, y double, z double")
    got = sorted((r["a"], r["b"], round(r["d2"], 6)) for r in P.segment_graph(df, radius).collect())
    best = {}
    for s, _, *p in rows:
        for t, _, *q in rows:
            if s < t:
                d2 = sum((a - b) ** 2 for a, b in zip(p, q))
                best[s, t] = min(best.get((s, t), math.inf), d2)
    part, want = {s: s for s in range(14)}, []
    for (s, t), d2 in sorted(best.items(), key=lambda e: e[1]):
        if part[s] != part[t]:
            want.append((s, t, round(d2, 6)))
            part = {k: part[s] if v == part[t] else v for k, v in part.items()}
    assert got == sorted(want) and len(got) == 13
    with pytest.raises(ValueError):
        P.segment_graph(df, 0.0)


def test_knn_of_a_dense_middle(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(0, 0.01, (600, 3)), rng.uniform(-5, 5, (30, 3))])  # cells for the whole would hold the middle at once
    df = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(p)], "cloud int, idx bigint, x double, y double, z double")
    widths, real = [], Q._spread_cells
    monkeypatch.setattr(Q, "_spread_cells", lambda rows: widths.append(rows.agg(F.max("_s")).first()[0]) or real(rows))
    got = {(r["i"], r["rank"]): r["j"] for r in Q.knn(df, 2).collect()}
    d = ((p[:, None] - p) ** 2).sum(-1)
    assert got == {(i, k + 1): int(j) for i in range(len(p)) for k, j in enumerate(np.argsort(d[i], kind="stable")[:2])}
    assert widths[0] < 0.1  # before: over 2, where the middle's 600 points made all their pairs
