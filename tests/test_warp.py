"""Affine resampling against dense NumPy."""

import numpy as np
import pytest

from gridloom.operators import warp as W
from gridloom.sources import arrays as A

SHAPE = (9, 7, 3)  # x, y, z
TURN = [[0.9, -0.3, 1.5], [0.2, 1.1, -0.7]]
FULL = [[0.9, -0.3, 0.1, 1.5], [0.2, 1.1, 0.0, -0.7], [0.05, 0.0, 0.8, 0.4]]


def weight(kernel, d):
    d = abs(d)
    if kernel == "linear":
        return max(0.0, 1 - d)
    a = -0.75
    return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0.0


def brute(v, matrix, kernel, border, constant, out):
    m = np.eye(4)
    n = len(matrix)
    m[:n, :n], m[:n, 3] = np.array(matrix)[:, :n], np.array(matrix)[:, n]
    back = np.linalg.inv(m)

    def at(p):
        q = []
        for c, n in zip(p, v.shape):
            if border == "replicate":
                c = min(max(c, 0), n - 1)
            elif border == "reflect":
                c = c % (2 * n)
                c = c if c < n else 2 * n - 1 - c
            elif not 0 <= c < n:
                return constant
            q.append(c)
        return v[tuple(q)]

    done = np.zeros(out)
    for p in np.ndindex(*out):
        s = np.round((back @ [*p, 1])[:3], 9)
        if kernel == "nearest":
            done[p] = at(np.floor(s + 0.5).astype(int))
            continue
        low = np.floor(s).astype(int)
        reach = range(-1, 3)
        for d in np.ndindex(4, 4, 4):
            q = [low[k] + reach[d[k]] for k in range(3)]
            w = np.prod([weight(kernel, s[k] - q[k]) for k in range(3)])
            if w:
                done[p] += w * at(q)
    return done


CASES = [("nearest", "constant", TURN), ("linear", "constant", TURN), ("linear", "reflect", FULL), ("cubic", "replicate", TURN), ("cubic", "constant", FULL), ("nearest", "reflect", FULL)]


@pytest.mark.parametrize("kernel,border,matrix", CASES)
def test_warp(spark, tmp_path, kernel, border, matrix):
    v = np.random.default_rng(1).integers(0, 100, SHAPE).astype(float)
    out = (8, 9, 4)
    want = brute(v, matrix, kernel, border, -5.0, out)
    df = spark.createDataFrame([(*p, float(c)) for p, c in np.ndenumerate(v) for p in [p]], "x bigint, y bigint, z bigint, v double")
    got = np.full(out, np.nan)
    for r in W.warp(df, SHAPE, matrix, kernel, border, -5.0, out_shape=out).collect():
        got[r["x"], r["y"], r["z"]] = r["v"]
    assert np.allclose(got, want, atol=1e-6)
    spec = A.create_array(A.array_spec(f"{tmp_path}/in|zarr:", ("c", "z", "y", "x"), (1, *SHAPE[::-1]), (1, 2, 3, 4), "f8"))
    A.write_array(A.from_numpy(spark, v.transpose()[None]), spec.path)
    target = f"{tmp_path}/out|zarr:"
    report = W.warp_array(spark, spec.path, target, matrix, kernel, border, -5.0, out_shape=out, overrides={"chunks": [1, 2, 5, 3]})
    stored = A.read_block(A.open_array(target), A.open_array(target).files(), (0, 0, 0, 0), (1, *out[::-1]))[0].transpose()
    assert np.allclose(stored, want, atol=1e-6) and report.missing == report.chunks == 2 * 2 * 3
    assert W.warp_array(spark, spec.path, target, matrix, kernel, border, -5.0, out_shape=out, overrides={"chunks": [1, 2, 5, 3]}).missing == 0


def test_maps():
    assert np.allclose(W.inverse_map([[2, 0, 4], [0, 1, 0]]), [[0.5, 0, 0, -2], [0, 1, 0, 0], [0, 0, 1, 0]])
    assert np.allclose(W.inverse_map([[2, 0, 4], [0, 1, 0]], True), [[2, 0, 0, 4], [0, 1, 0, 0], [0, 0, 1, 0]])
    for bad in ([[1, 2], [3, 4]], [[1, 1, 0], [1, 1, 0]]):
        with pytest.raises(ValueError):
            W.inverse_map(bad)
    for t in (0.0, 0.3, 0.9):
        for kernel in ("linear", "cubic"):
            assert abs(sum(w for _, w in W.taps(kernel, t)) - 1) < 1e-12
