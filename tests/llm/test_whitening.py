"""Embedding whitening against dense NumPy."""

import numpy as np
import pytest

from gridloom.llm.whitening import components, polar_factor, whiten

SCHEMA = "vec_id bigint, embedding array<float>, x string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "a", 3) for i, v in rows], SCHEMA)


def spd(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [[3, 2, 1], [1, 1, 1, 1], [5, 5, 5, 1, 1], [1e8, 1, 1e-3], list(range(1, 65)), [1 + 1e-9 * k for k in range(20)], [4, 0, 0, 0], [2, 2, 2, 2, 2, 2, 2, 7], list(np.geomspace(1e-6, 1, 40))],
)
def test_components(values):
    a = spd(values)
    got, vectors = components(a, 8)
    want = np.sort(values)[::-1][:8]
    want = want[want > 1e-10 * want[0]]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9, atol=1e-12 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * got) < 1e-11 * want[0]


def test_components_of_nothing():
    assert components(np.zeros((3, 3)), 8)[0].size == 0 and components(np.zeros((0, 0)), 8)[0].size == 0


def test_polar_factor_of_ill_conditioned():
    a = spd([1, -1e-12, 3, -2, 1e-6])
    w, q = np.linalg.eigh(a)
    assert np.allclose(polar_factor(a), q @ np.diag(np.sign(w)) @ q.T, atol=1e-3)  # the sign of 1e-12 is known to 1e-4
    b = spd([1, -0.5, 3, -2, 1e-3])
    w, q = np.linalg.eigh(b)
    assert np.allclose(polar_factor(b), q @ np.diag(np.sign(w)) @ q.T, atol=1e-11)


def plain(rows, most=8):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    spread = x * n - s
    d = (spread / n).astype(float)
    e, q = np.linalg.eigh(d.T @ d / n)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return kept, n, [int((r**2).sum()) for r in spread], d @ q / np.sqrt(e), e, float(np.trace(d.T @ d / n))


def test_whiten_equals_dense(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((400, 12)) * np.geomspace(1, 0.01, 12) @ rng.standard_normal((12, 12)) + rng.standard_normal(12)
    rows = list(enumerate(data.tolist()))
    rows[7] = (7, None)
    rows[8] = (8, [None, *rows[8][1][1:]])
    rows[9] = (9, [float("nan"), *rows[9][1][1:]])
    rows[10] = (10, [*rows[10][1][:-1], float("-inf")])
    rows += [(None, rows[11][1]), (12, rows[12][1]), (999, [])]
    kept, n, deviation, whitened, e, trace = plain([r for r in rows if r[1] != []])
    got = whiten(frame(spark, rows).repartition(5)).collect()
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-8
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], r)
    signs = None
    for k, (i, _) in enumerate(kept):
        mine = [by[i][c] for c in range(1, 9)]
        assert {r["deviation"] for r in mine} == {deviation[k]}
        w = np.array([r["whitened"] for r in mine])
        signs = np.sign(w * whitened[k]) if signs is None else signs
        assert np.allclose(w * signs, whitened[k], atol=1e-7)
        assert np.allclose([r["explained"] for r in mine], e / trace, rtol=1e-9)


def test_whiten_edge_cases(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whiten(frame(spark, [(1, [0.5, 1.0])])).collect() == []
    assert whiten(frame(spark, [(1, [0.5, 1.0])] * 5)).collect() == []
    two = whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0, 2.0])])).collect()  # the second length is rarer
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9)) for r in two} == {(1, 1, 2, 1024**2, 1.0), (2, 1, 2, 1024**2, 1.0)}
    assert {round(r["explained"], 9) for r in two} == {1.0}
    wide = whiten(frame(spark, [(1, [2.0**39, 0.0]), (2, [-(2.0**39), 1.0]), (3, [2.0**41, 0.0])])).collect()
    assert {r["vec_id"] for r in wide} == {1, 2} and {r["deviation"] for r in wide} == {None}  # beyond a long


def test_whiten_does_not_shuffle_rows(spark):
    plan = whiten(frame(spark, [(i, [i * 0.1, (i * i) % 7]) for i in range(50)]))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
