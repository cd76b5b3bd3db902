"""Active contours and orientation against plain versions."""

import numpy as np
import pytest

from gridloom.operators import contours as C
from gridloom.operators import points as P

LINES = [[(0, -1), (0, 1)], [(-1, 0), (1, 0)], [(-1, -1), (1, 1)], [(-1, 1), (1, -1)]]


def shifted(u, d):
    wide = np.pad(u, 1)
    return wide[1 + d[0] : 1 + d[0] + u.shape[0], 1 + d[1] : 1 + d[1] + u.shape[1]]


def plain_contour(v, rounds):
    x, y = np.indices(v.shape)
    u = (x // 5 + y // 5) % 2
    for k in range(rounds):
        c0 = v[u == 0].sum() / ((u == 0).sum() + 1e-8)
        c1 = v[u == 1].sum() / ((u == 1).sum() + 1e-8)
        pull = np.abs(np.gradient(u.astype(float))).sum(0) * ((v - c1) ** 2 - (v - c0) ** 2)
        u = np.where(pull < 0, 1, np.where(pull > 0, 0, u))
        closed = lambda w: np.min([np.max([w, *(shifted(w, d) for d in line)], axis=0) for line in LINES], axis=0)
        opened = lambda w: np.max([np.min([w, *(shifted(w, d) for d in line)], axis=0) for line in LINES], axis=0)
        u = opened(closed(u)) if k % 2 == 0 else closed(opened(u))
    return u


def plain_mask(v, background, rounds, erosions, dilations):
    m = plain_contour(v, rounds) == 1
    if background is not None and m[background]:
        m = ~m
    cross = [(0, -1), (0, 1), (-1, 0), (1, 0)]
    for _ in range(erosions):
        m = np.logical_and.reduce([m, *(shifted(m, d) for d in cross)])
    for _ in range(dilations):
        m = np.logical_or.reduce([m, *(shifted(m, d) for d in cross)])
    outside = np.zeros_like(m)
    outside[[0, -1]], outside[:, [0, -1]] = ~m[[0, -1]], ~m[:, [0, -1]]
    while True:
        more = np.logical_or.reduce([outside, *(shifted(outside, d) for d in cross)]) & ~m
        if (more == outside).all():
            return ~outside
        outside = more


@pytest.mark.parametrize("rounds,background,erosions,dilations", [(2, (0, 0), 1, 2), (3, None, 0, 0)])
def test_contour_mask(spark, rounds, background, erosions, dilations):
    rng = np.random.default_rng(rounds)
    x, y = np.indices((23, 19))
    planes = []
    for r in (6, 4):
        far = np.hypot(x - 11, y - 9)
        planes.append(np.where((far < r + 2) & (far > 1.5), 80.0, 20.0) + rng.normal(0, 12, x.shape))
    df = spark.createDataFrame([(int(i), int(j), z, float(p[i, j])) for z, p in enumerate(planes) for i, j in np.ndindex(*p.shape)], "x bigint, y bigint, z bigint, v double").repartition(3)
    got = np.zeros((2, 23, 19), bool)
    for r in C.contour_mask(df, (23, 19, 2), background, rounds, erosions, dilations).collect():
        got[r["z"], r["x"], r["y"]] = r["mask"]
    for z, p in enumerate(planes):
        assert np.array_equal(got[z], plain_mask(p, background, rounds, erosions, dilations))


def test_orientation(spark):
    rng = np.random.default_rng(4)
    clouds = {c: rng.normal(size=(40, 3)) * [5, 2, 0.5] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] for c in range(3)} | {9: np.ones((1, 3))}
    df = spark.createDataFrame([(c, i, *map(float, p)) for c, x in clouds.items() for i, p in enumerate(x)], "cloud int, idx bigint, x double, y double, z double")
    got = {r["cloud"]: r for r in P.orientation(df).collect()}
    assert set(got) == {0, 1, 2}  # one point has no orientation
    for c, r in got.items():
        cov = np.cov(clouds[c].T)
        axes, turn = np.array(r["axes"]), np.array(r["rotation"])
        assert np.allclose(r["spread"], np.sort(np.linalg.eigvalsh(cov))[::-1]) and np.allclose(axes @ cov @ axes.T, np.diag(r["spread"]), atol=1e-9)
        assert np.allclose(turn @ axes[0], [0, 0, 1]) and np.allclose(turn @ axes[1], [0, 1, 0]) and np.isclose(np.linalg.det(turn), 1)


def test_curve_order_and_back(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(0, int(i), *map(float, p)) for i, p in zip(rng.permutation(500)[:16], rng.random((16, 3)))], "cloud int, idx bigint, x double, y double, z double")
    rows = P.with_reverse(P.median_split_order(df, 4)).collect()
    by_rank = sorted(rows, key=lambda r: r["rank"])
    ordered = sorted(rows, key=lambda r: r["idx"])
    assert [by_rank[r["rank"]]["idx"] for r in ordered] == [r["idx"] for r in ordered] and [r["place"] for r in ordered] == list(range(16))
    assert all(ordered[r["place"]]["idx"] == r["idx"] for r in rows)


@pytest.mark.parametrize("tile, worn, grown", [(8, 1, 1), (8, 1, 10), (64, 1, 1)])
def test_contour_mask_in_tiles(spark, monkeypatch, tile, worn, grown):
    monkeypatch.setattr(C, "TILE", tile)
    monkeypatch.setattr(C, "PLANES", 2)
    rng = np.random.default_rng(3)
    x, y = np.indices((27, 21))
    planes = [np.where((abs(np.hypot(x - 13, y - 10) - r) < 2.5) & ((y < 17) | (r != 6)), 80.0, 20.0) + rng.normal(0, 9, x.shape) for r in (6, 8, 4)]
    df = spark.createDataFrame([(int(i), int(j), z, float(p[i, j])) for z, p in enumerate(planes) for i, j in np.ndindex(*p.shape)], "x bigint, y bigint, z bigint, v double").repartition(3)
    out = C.contour_mask(df, (27, 21, 3), (0, 0), 2, worn, grown)
    got = np.zeros((3, 27, 21), bool)
    rows = out.collect()
    for r in rows:
        got[r["z"], r["x"], r["y"]] = r["mask"]
    assert len(rows) == 3 * 27 * 21
    for z, p in enumerate(planes):
        assert np.array_equal(got[z], plain_mask(p, (0, 0), 2, worn, grown))
    assert any(plain_mask(p, (0, 0), 2, worn, grown).any() for p in planes)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # before: windows along lines exchanged all voxels
