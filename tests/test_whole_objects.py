"""Object, graph and box queries over whole tables, against plain versions."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.test_whole_volume import SHAPE, volume, voxels  # noqa: F401


def rows(spark, name, path):
    return [tuple(r) for r in entry.queries()[name](spark, path).collect()]


def least(pairs, nodes=()):
    """node -> the least node that it reaches."""
    parent = {n: n for n in [*nodes, *itertools.chain(*pairs)]}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in parent}


def number(z, y, x):
    return (z * 20 + y) * 20 + x


def faces():
    for p in voxels():
        for k in range(3):
            q = tuple(c + (i == k) for i, c in enumerate(p))
            if q[k] < SHAPE[k]:
                yield p, q


@pytest.fixture(scope="module")
def tables(spark, volume):  # noqa: F811
    """Adds the other tables to the folder; ids go beyond every cut of the SQL."""
    path = volume[0]
    rng = np.random.default_rng(6)
    orders = [(k, int(rng.integers(1, 3000))) for k in range(1, 1500)]
    line = [(k, int(rng.integers(0, 40)), int(rng.integers(0, 10)), float(rng.integers(1, 50))) for k in range(300, 700)]
    part = [(k, int(rng.integers(1, 51))) for k in range(1, 700)]
    points = [(k, k % 2, [float(x) for x in rng.normal(size=4)]) for k in range(150)]
    for name, data, schema in (
        ("orders", orders, "o_orderkey bigint, o_custkey bigint"),
        ("lineitem", line, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double"),
        ("part", part, "p_partkey bigint, p_size int"),
        ("embeddings", points, "vec_id bigint, label int, embedding array<double>"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    scores = defaultdict(float)
    for _, p, s, q in line:
        a, b = sorted((p % 151, (p + s) % 151))
        if a != b:
            scores[a, b] = max(scores[a, b], q)
    return path, orders, dict(scores), part, points


def test_connected_components(spark, volume):  # noqa: F811
    path, _, label, _ = volume
    pairs = [(number(*p), number(*q)) for p, q in faces() if label[p] == label[q] != 0]
    assert dict(rows(spark, "connected_components", path)) == least(pairs, [number(*p) for p in voxels() if label[p]])


def test_fill_holes(spark, volume):  # noqa: F811
    path, v, _, _ = volume
    label = {p: 0 if v[p] > 120 and (p[1] + p[2]) % 3 > 0 else 1 + p[2] // 10 for p in voxels()}
    part = least([(p, q) for p, q in faces() if label[p] == label[q] == 0], [p for p in voxels() if not label[p]])
    outside = {part[p] for p in part if any(c in (0, n - 1) for c, n in zip(p, SHAPE, strict=True))}
    near = defaultdict(set)
    for p, q in faces():
        for a, b in ((p, q), (q, p)):
            if label[a] == 0 != label[b]:
                near[part[a]].add(label[b])
    filled = {c: next(iter(n)) for c, n in near.items() if len(n) == 1 and c not in outside}
    assert any(c[0] >= 4 for c in filled)
    assert dict(rows(spark, "fill_holes", path)) == {number(*p): filled.get(part.get(p), x) for p, x in label.items()}


def test_seg_ellipticity(spark, volume):  # noqa: F811
    path, _, _, user = volume
    want = {}
    for u in range(1, 40):
        at = np.argwhere(user == u)
        want[u] = 3 * 5**0.5 / (100 * np.pi) * len(at) / np.linalg.det(np.cov(at.T)) ** 0.5
    assert {r[0]: r[2] for r in rows(spark, "seg_ellipticity", path)} == pytest.approx(want, abs=2e-5)


def test_biconnected_components(spark, volume):  # noqa: F811
    path, _, _, user = volume
    want = {tuple(sorted((int(user[p]), int(user[q])))) for p, q in faces() if user[p] != user[q]}
    got = [r[2:] for r in rows(spark, "biconnected_components", path)]
    assert len(got) == len(set(got))  # each edge is in one component
    assert set(got) == want
    assert rows(spark, "articulation_points", path) == []


def test_equivalences(spark, tables):
    path, orders, *_ = tables
    assert dict(rows(spark, "equivalences", path)) == least([(c, 1000000 + k % 900) for k, c in orders])


def test_graph_edges(spark, volume, tables):  # noqa: F811
    path, scores, user = volume[0], tables[2], volume[3]
    assert {(a, b): s for a, b, s in rows(spark, "graph_edges_dedup", path)} == scores
    parts = {(b, sv): pcg for b, sv, _, pcg in rows(spark, "graph_pcg_ids", path)}
    assert {(x // 5 + 4 * (y // 4 + 5 * (z // 4)), int(user[z, y, x])) for z, y, x in voxels() if user[z, y, x]} == set(parts)
    inside = {(parts[b, p], parts[b, q]): s for b in {b for b, _ in parts} for (p, q), s in scores.items() if (b, p) in parts and (b, q) in parts}
    got = rows(spark, "graph_block_edges", path)
    assert {(i, j): s for _, kind, i, j, s in got if kind == "in" and i != j} == inside
    assert dict(rows(spark, "graph_components", path)) == least(list(inside), parts.values())
    where = lambda sv: [b for b, x in parts if x == sv]
    split = lambda b: (b % 4, b // 4 % 5, b // 20)
    meets = lambda p, q: any(all(abs(i - j) <= 1 for i, j in zip(split(b), split(c), strict=True)) for b in where(p) for c in where(q))
    assert set(rows(spark, "graph_dropped", path)) == {e for e in scores if not meets(*e)}


def test_sq_distances(spark, tables):
    path, *_, points = tables
    want = {(c, i, j): sum((a - b) ** 2 for a, b in zip(p[:3], q[:3], strict=True)) for i, c, p in points for j, d, q in points if c == d}
    assert {tuple(r[:3]): r[3] for r in rows(spark, "sq_distances", path)} == pytest.approx(want, abs=2e-6)


def test_box_intersections(spark, tables):
    path, _, _, part, _ = tables
    boxes = [(k, np.array([s, k % 40, k % 25]), np.array([s + s % 7 + 1, k % 40 + k % 5 + 2, k % 25 + k % 3 + 1])) for k, s in part]
    want = set()
    for (i, a0, a1), (j, b0, b1) in itertools.product(boxes, boxes):
        lo, hi = np.maximum(a0, b0), np.minimum(a1, b1)
        if (lo < hi).all():
            want.add((i, j, *map(int, lo), *map(int, hi)))
    got = entry.queries()["box_intersections"](spark, path).select("id_a", "id_b", "x0", "y0", "z0", "x1", "y1", "z1").collect()
    assert len(got) == len(want)
    assert set(map(tuple, got)) == want
