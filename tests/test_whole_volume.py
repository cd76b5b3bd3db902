"""Volume and object queries over every plane of a table, against plain versions."""

import datetime
import itertools
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from gridloom.operators import volumes as V
from gridloom.plans.views import TYPES

SHAPE = (9, 20, 20)  # z, y, x: more planes than any query's SQL looks at


@pytest.fixture(scope="module")
def volume(spark, tmp_path_factory):
    """The folder of a made-up ``events`` table and its values, labels and users by z, y, x."""
    rng = np.random.default_rng(5)
    n = int(np.prod(SHAPE))
    v, kind, user = np.round(rng.gamma(1.2, 60, n), 2), rng.integers(0, 5, n), rng.integers(0, 40, n)
    ts = datetime.datetime(2024, 1, 1)
    rows = [(i, ts, int(user[i]), TYPES[kind[i]], float(v[i])) for i in range(n)]
    path = str(tmp_path_factory.mktemp("volume"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return path, v.reshape(SHAPE), kind.reshape(SHAPE), user.reshape(SHAPE)


def voxels():
    return itertools.product(*map(range, SHAPE))


def by_voxel(spark, name, path, value="v"):
    rows = entry.queries()[name](spark, path).collect()
    got = {(r["z"], r["y"], r["x"]): r[value] for r in rows}
    assert len(got) == len(rows)
    return got


def box(a, z, y, x, ry=1, rx=1):
    return a[z, max(y - ry, 0) : y + ry + 1, max(x - rx, 0) : x + rx + 1]


NEAR = {
    "moving_std": np.std,
    "max_filter": np.max,
    "min_filter": np.min,
    "median_filter": np.median,
    "uniform_filter": np.mean,
    "percentile_filter": lambda b: np.quantile(b, 0.25),
}


@pytest.mark.parametrize("name", NEAR)
def test_filters(spark, volume, name):
    path, v, *_ = volume
    want = {p: float(NEAR[name](box(v, *p))) for p in voxels()}
    assert by_voxel(spark, name, path) == pytest.approx(want, abs=2e-6)


def test_mask_fov(spark, volume):
    path, v, *_ = volume
    assert by_voxel(spark, "mask_fov", path, "mask") == {p: bool((box(v, *p, ry=1, rx=2) > 200).any()) for p in voxels()}


def test_sums(spark, volume):
    path, v, *_ = volume
    assert by_voxel(spark, "integral_image", path) == pytest.approx({(z, y, x): v[z, : y + 1, : x + 1].sum() for z, y, x in voxels()}, abs=2e-4)
    want = {(z, y, x): v[z, y : y + 2, x : x + 3].sum() for z, y, x in voxels() if x <= 17 and y <= 18}
    assert by_voxel(spark, "box_sum", path) == pytest.approx(want, abs=2e-4)


def test_high_pass(spark, volume):
    path, v, *_ = volume
    want = {p: v[p] + (255 - box(v, *p)).min() for p in voxels()}
    assert by_voxel(spark, "high_pass", path) == pytest.approx(want, abs=2e-4)


def test_upsample_nearest(spark, volume):
    path, v, *_ = volume
    want = {(3 * z + j, y, 2 * x + i): v[z, y, x] for z, y, x in voxels() for i in range(2) for j in range(3)}
    assert by_voxel(spark, "upsample_nearest", path) == want


def test_objects_context(spark, volume):
    path, v, *_ = volume
    rows = entry.queries()["objects_context"](spark, path).collect()
    got = {(r["object"], r["dx"], r["dy"], r["dz"]): r["v"] for r in rows}
    assert len(got) == len(rows)
    want = {}
    for z, y, x in voxels():
        for k, j, i in itertools.product((-1, 0), (-1, 0, 1), (-2, -1, 0, 1, 2)):
            at = (z + k, y + j, x + i)
            inside = all(0 <= c < n for c, n in zip(at, SHAPE, strict=True))
            want[(z * 20 + y) * 20 + x, i, j, k] = v[at] if inside else 0.0
    assert got == want


def test_objects_context_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "WINDOW_BLOCK", 3)
    monkeypatch.setattr(V, "WINDOWS_AT_ONCE", 7)
    rng = np.random.default_rng(5)
    voxels = [(int(x), int(y), int(z), float(v) if v > 0.1 else None) for x, y, z, v in zip(*rng.integers(-6, 7, (3, 400)), rng.random(400))]  # gaps, and several voxels at some places
    centres = [(f"o{k}", *map(int, rng.integers(-8, 9, 3))) for k in range(60)] + [("far", 99, 0, 0), ("lost", None, 1, 1), (None, 0, 0, 0)]
    vox = spark.createDataFrame(voxels, "x bigint, y bigint, z bigint, v double").repartition(3)
    out = V.objects_context(vox, spark.createDataFrame(centres, "object string, x bigint, y bigint, z bigint"), (4, 3, 1))
    want = Counter()
    held = {}
    for x, y, z, v in voxels:
        held.setdefault((x, y, z), []).append(v or 0.0)
    for o, x, y, z in centres:
        for i, j in itertools.product(range(-2, 2), range(-1, 2)):
            for v in held.get((x + i, y + j, z), [0.0]) if x is not None else [0.0]:
                want[o, i, j, 0, v] += 1
    assert Counter(map(tuple, out.collect())) == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # before: every voxel of every window went through an exchange
