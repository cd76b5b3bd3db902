"""The closest points of segments against all pairs; settled segments meet no more in wide cells."""

import numpy as np

from gridloom.operators import proximity as P


def test_closest_pairs_in_growing_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(s, 1000 * s + k, *map(float, rng.normal(s // 3, 0.3, 3).round(3))) for s in range(9) for k in range(40)]
    rows += [(2, 1, *rows[0][2:]), (2, 0, *rows[0][2:]), (0, 7, *rows[0][2:])]  # copies of a place, of one segment and another
    rows += [(20, 5000, -9.0, 0.0, 0.0), (21, 5001, -9.0, 0.9, 0.0), (22, 5002, -9.0, 3.0, 0.0), (None, 5003, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "segment bigint, idx bigint, x double, y double, z double")
    sizes, kept = [], P.materialized

    def counted(frame, name):
        out = kept(frame, name)
        if name == "closest":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(P, "materialized", counted)
    got = {(r["a"], r["b"]): (r["d2"], r["ia"], r["ib"]) for r in P.closest_pairs(df, 1.0).collect()}
    want = {}
    for a, i, *p in rows:
        for b, j, *q in rows:
            if a is not None and b is not None and a < b:
                d2 = sum((u - v) ** 2 for u, v in zip(p, q))
                if d2 <= 1:
                    want[a, b] = min(want.get((a, b), (9, 0, 0)), (d2, i, j))
    assert got.keys() == want.keys()
    for k, (d2, i, j) in want.items():
        assert abs(got[k][0] - d2) < 1e-12 and got[k][1:] == (i, j)
    assert len(sizes) > 1 and sizes[0] > 0  # before: one round in cells of the radius
