"""Tree and graph algorithms against direct versions."""

import random

import pytest

from gridloom.operators import trees as T


def test_best_cut(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(9)], "graph int, a bigint, b bigint")
    labels = spark.createDataFrame([(0, i, 1 if i < 5 else 2) for i in range(10)], "graph int, node bigint, label int")
    r = T.best_cut(edges, labels).first()
    assert (r["a"], r["b"], r["consistency"], r["initial"]) == (4, 5, 10, 5)
    with pytest.raises(Exception, match="not a tree"):
        T.best_cut(edges.union(spark.createDataFrame([(0, 0, 9)], edges.schema)), labels).collect()


def parts(edges, without):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if without not in (a, b):
            parent[find(a)] = find(b)
    return find


def test_biconnected(spark):
    rng = random.Random(1)
    rows = {(g, *sorted(rng.sample(range(14), 2))) for g in range(6) for _ in range(16)}
    got = T.biconnected(spark.createDataFrame(sorted(rows), "graph int, a bigint, b bigint"))
    found = {}
    for r in got.collect():
        found.setdefault(r["graph"], {})[r["a"], r["b"]] = r["component"]
    cuts = {tuple(r) for r in T.articulation_points(got).collect()}
    for g in range(6):
        edges = [(a, b) for k, a, b in rows if k == g]
        assert set(found[g]) == set(edges)
        nodes = {x for e in edges for x in e}
        for v in nodes:
            whole, cut = parts(edges, None), parts(edges, v)
            mine = {x for x in nodes if x != v and whole(x) == whole(v)}
            assert ((g, v) in cuts) == (len({cut(x) for x in mine}) > 1)
        for e in edges:
            for f in edges:
                # edges share a component if no node's removal parts them
                meet = set(e) & set(f)
                if len(meet) == 1:
                    (v,) = meet
                    (x,), (y,) = set(e) - meet, set(f) - meet
                    cut = parts(edges, v)
                    assert (found[g][e] == found[g][f]) == (cut(x) == cut(y))


def plain_internal(blocks, outer):
    """target of each internal block ({number: nodes}): rooted at the least block with a node of ``outer``, else at the least joint."""
    joints = {n for k, b in blocks.items() for n in b if sum(n in c for c in blocks.values()) > 1}
    out, seen = {}, set()
    for start in sorted(blocks):
        if start in seen:
            continue
        tree, todo = {start}, [start]
        while todo:
            k = todo.pop()
            more = {m for m in blocks if m not in tree and blocks[m] & blocks[k] & joints}
            tree |= more
            todo += more
        seen |= tree
        fixed = sorted(k for k in tree if blocks[k] & outer)
        mine = {n for k in tree for n in blocks[k] & joints}
        if not mine:
            continue
        above, order = {}, [("b", fixed[0])] if fixed else [("n", min(mine))]
        above[order[0]] = None
        for kind, x in order:
            near = [("n", n) for n in blocks[x] & joints] if kind == "b" else [("b", k) for k in tree if x in blocks[k]]
            for y in near:
                if y not in above:
                    above[y] = (kind, x)
                    order.append(y)
        held = {v: v[0] == "b" and v[1] in fixed for v in order}
        for v in reversed(order):
            if held[v] and above[v]:
                held[above[v]] = True
        for v in order:
            if v[0] == "b" and above[v] and not held[v]:
                up = above[v]
                while above[up] and not held[above[up]] and above[above[up]]:
                    up = above[above[up]]
                out[v[1]] = up[1]
    return out


def test_internal_objects_equal_a_plain_version(spark):
    rng = random.Random(5)
    rows = {(g, *sorted(rng.sample(range(26), 2))) for g in range(5) for _ in range(27)}
    comps = T.biconnected(spark.createDataFrame(sorted(rows), "graph int, a bigint, b bigint"))
    outer = {g: set() if g == 0 else {rng.randrange(26) for _ in range(3)} for g in range(5)}
    blocks = {}
    for r in comps.collect():
        blocks.setdefault(r["graph"], {}).setdefault(r["component"], set()).update((r["a"], r["b"]))
    got = {}
    for r in T.internal_objects(comps, spark.createDataFrame([(g, n) for g, s in outer.items() for n in s], "graph int, node bigint")).collect():
        got.setdefault(r["graph"], {})[r["component"]] = r["target"]
    for g in range(5):
        assert got.get(g, {}) == plain_internal(blocks[g], outer[g])
    assert sum(map(len, got.values())) > 10


def test_best_cut_of_vectors(spark):
    rng = random.Random(6)
    edges, labels, want = [], [], {}
    for g in range(4):
        n = 30
        mine = [(rng.randrange(i), i) for i in range(1, n)]
        vec = {i: [rng.randint(0, 5) for _ in range(3)] for i in range(n) if rng.random() < 0.8}
        edges += [(g, b, a) for a, b in mine]
        labels += [(g, i, [float(x) for x in v]) for i, v in vec.items()]
        best = None
        for a, b in mine:
            find = parts([e for e in mine if e != (a, b)], None)
            side = [[sum(vec.get(i, [0] * 3)[k] for i in range(n) if (find(i) == find(a)) == s) for k in range(3)] for s in (True, False)]
            best = min(best or (1, ()), (-float(sum(map(max, side))), (a, b)))
        want[g] = (*best[1], -best[0], float(max(sum(v[k] for v in vec.values()) for k in range(3))))
    got = T.best_cut(spark.createDataFrame(edges, "graph int, a bigint, b bigint"), spark.createDataFrame(labels, "graph int, node bigint, vector array<double>"))
    assert {r["graph"]: (r["a"], r["b"], r["consistency"], r["initial"]) for r in got.collect()} == want
    with pytest.raises(ValueError, match="not a tree"):
        T.best_cut(spark.createDataFrame([(0, 1, 2), (0, 3, 4)], "graph int, a bigint, b bigint"), spark.createDataFrame([(0, 1, 1)], "graph int, node bigint, label int"))


def test_plans_have_no_grouped_python(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(6)] + [(0, None, 1)], "graph int, a bigint, b bigint")
    found = T.biconnected(edges)
    assert found.count() == 6 and T.biconnected(edges.limit(0)).count() == 0 and T.internal_objects(T.biconnected(edges.limit(0))).count() == 0
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in T.internal_objects(found)._jdf.queryExecution().toString()
