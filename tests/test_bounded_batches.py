"""Tasks that compare many rows with many hold small matrices only; the rows are the same."""

import numpy as np

from gridloom.operators import alignment as A
from gridloom.operators import points as P


def shapes_seen(monkeypatch, module, name):
    seen = []
    real = getattr(np, name)
    monkeypatch.setattr(np, name, lambda *a, **k: seen.append(max(np.size(x) for x in (a[0] if isinstance(a[0], tuple) else (a[0],)))) or real(*a, **k))
    return seen


def run_in_process(df, fn, kind):
    """Runs a task's function here, on one batch of all rows."""
    return list(fn(iter([df.toPandas() if kind == "pandas" else df.toArrow().combine_chunks().to_batches()[0]])))


def test_top_matches_in_small_matrices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in p]) for i, p in enumerate(rng.integers(-1, 2, (150, 5)) + 0.5)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>").coalesce(1)
    monkeypatch.setattr(P, "MATCH_QUERIES", 16)
    monkeypatch.setattr(P, "MATCH_ROWS", 20)
    caught, kept = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, fn, schema: caught.append(fn) or kept(self, fn, schema))
    out = P.top_matches(df, df, 6)
    seen = shapes_seen(monkeypatch, np, "lexsort")
    (whole,) = caught
    parts = run_in_process(df, whole, "pandas")
    assert max(seen) <= 16 * 26 and sum(map(len, parts)) == 150 * 6  # before: 150 x 150 at once
    monkeypatch.undo()
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], round(r["cosine"], 9)))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    for i in range(150):
        assert [round(c, 9) for *_, c in sorted(got[i])] == [round(c, 9) for c in sorted(s[i], reverse=True)[:6]]


def test_cross_distance_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), k, float(rng.normal())) for i in range(90) for k in range(3)]
    df = spark.createDataFrame(rows, "id bigint, anchor int, e double")
    caught, kept = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: caught.append((self, fn)) or kept(self, fn, schema))
    monkeypatch.setattr(A, "PAIRS", 300, raising=False)
    out = A.cross_distance(df, df)
    left, fn = caught[0]
    batches = run_in_process(left.coalesce(1), fn, "arrow")
    assert max(b.num_rows for b in batches) <= 300 and sum(b.num_rows for b in batches) == 8100  # before: 8,100 at once
    assert out.count() == 8100 and out.where("a = b AND abs(distance) > 1e-9").count() == 0
