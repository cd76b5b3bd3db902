"""Distance transforms and what follows from them, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import distance as D

SCHEMA = "x bigint, y bigint, z bigint, label bigint, keep boolean"


def frame(spark, labels, keep=None):
    return spark.createDataFrame([(x, y, z, int(v), None if keep is None else bool(keep[x, y, z])) for (x, y, z), v in np.ndenumerate(labels)], SCHEMA).repartition(5)


def dense(df, shape, column="label"):
    out = np.full(shape, -1.0)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = np.nan if r[column] is None else r[column]
    return out


def brute(labels, seeds, voxel, city=False):
    """(distance, least label) by comparing all voxels with all seeds."""
    at = np.argwhere(seeds)
    d, near = np.full(labels.shape, np.nan), np.full(labels.shape, np.nan)
    for p in np.ndindex(labels.shape):
        best = None
        for q in at:
            step = np.abs((q - np.array(p)) * voxel)
            v = (step.sum() if city else (step**2).sum(), labels[tuple(q)])
            best = v if best is None or v < best else best
        if best:
            d[p], near[p] = best
    return d, near


@pytest.mark.parametrize("voxel,share", [((1, 1, 1), 0.1), ((2, 1, 3), 0.05), ((1, 1, 1), 0.6), ((1, 1, 1), 0.0)])
@pytest.mark.parametrize("city", [False, True])
def test_nearest(spark, voxel, share, city):
    rng = np.random.default_rng(int(share * 100) + city)
    labels = rng.integers(1, 6, (7, 5, 6))
    seeds = rng.random(labels.shape) < share
    df = frame(spark, labels, seeds)
    got = D.nearest(df, F.col("keep"), dict(zip("xyz", voxel)), city_block=city)
    d, near = brute(labels, seeds, voxel, city)
    assert np.array_equal(dense(got, labels.shape, "d"), d, equal_nan=True)
    assert np.array_equal(dense(got, labels.shape, "near"), near, equal_nan=True)


def test_envelope_against_all_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 40):
        p = np.sort(np.stack([rng.choice(3 * n, n, replace=False) for _ in range(50)]), axis=1).astype(float)
        f = rng.integers(0, 30, (50, n)).astype(float)
        f[rng.random((50, n)) < 0.4] = np.inf
        near = rng.integers(1, 4, (50, n))
        got, label = D.envelope(p, f, near)
        all_ = f[:, None, :] + (p[:, :, None] - p[:, None, :]) ** 2
        assert np.array_equal(got, all_.min(axis=2))
        want = np.where(all_ == got[:, :, None], near[:, None, :], D.NONE).min(axis=2)
        assert np.array_equal(label, np.where(np.isinf(got), D.NONE, want))


def test_gaps_nulls_and_planes(spark):
    rows = [(0, 0, 0, 4, None), (9, 0, 0, 0, None), (9, 9, 0, None, None), (0, 0, 7, 0, None), (None, 1, 1, 3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["x"], r["y"], r["z"]): r["distance"] for r in D.distance_map(df, {"x": 1.0, "y": 2.0}).collect()}
    assert got == {(0, 0, 0): 0.0, (9, 0, 0): 9.0, (9, 9, 0): 405**0.5, (0, 0, 7): None}
    lost = df.where("NOT (x = 9 AND y = 0)")  # no line leads to (9, 9) any more
    assert {r["distance"] for r in D.distance_map(lost, {"x": 1.0, "y": 2.0}).where("x = 9").collect()} == {None}
    assert D.distance_map(df.limit(0), {"x": 1.0}).collect() == []
    with pytest.raises(ValueError):
        D.distance_map(df, {"x": 0.0})


def test_expand(spark):
    rng = np.random.default_rng(3)
    labels = np.where(rng.random((8, 6, 5)) < 0.06, rng.integers(1, 4, (8, 6, 5)), 0)
    keep = rng.random(labels.shape) < 0.7
    d, near = brute(labels, labels > 0, (1, 1, 2))
    dist = np.sqrt(d)
    got = D.expand_labels(frame(spark, labels, keep), {"x": 1, "y": 1, "z": 2}, 2.5, F.col("keep"))
    assert np.array_equal(dense(got, labels.shape), np.where(keep & (dist <= 2.5), near, labels))
    assert np.allclose(dense(got, labels.shape, "distance"), dist)
    got = D.expand_labels(frame(spark, labels), {"x": 1, "y": 1, "z": 2})
    assert np.array_equal(dense(got, labels.shape), near)


def plain_erode(labels, radius, min_size):
    out = labels.copy()
    for axis in range(3):
        a = np.moveaxis(out, axis, 0)
        a[1:][(a[:-1] != a[1:]) & (a[:-1] != 0)] = 0
    empty = np.argwhere(out == 0)
    done = out.copy()
    for p in np.ndindex(out.shape):
        if radius and len(empty) and (((empty - np.array(p)) ** 2).sum(axis=1) <= radius**2).any():
            done[p] = 0
    values, counts = np.unique(labels, return_counts=True)
    small = np.isin(labels, values[counts <= min_size])
    done[small] = labels[small]
    return done


@pytest.mark.parametrize("radius,min_size", [(0, 0), (1, 0), (2, 0), (2, 60), (1, 500)])
def test_eroded(spark, radius, min_size):
    labels = np.ones((11, 8, 7), int)
    labels[6:] = 2
    labels[:3, :3, :3] = 3
    labels[8, 2, 5] = 0
    got = D.eroded(frame(spark, labels), radius, min_size)
    assert np.array_equal(dense(got, labels.shape), plain_erode(labels, radius, min_size))


def test_eroded_plane_and_regrown(spark):
    ids = np.ones((20, 20, 1), int)
    ids[10:] = 2
    got = dense(D.eroded(frame(spark, ids), 1, 0, axes=("x", "y")), ids.shape)
    want = ids.copy()
    want[9:12] = 0
    assert np.array_equal(got, want)
    again = dense(D.expand_labels(frame(spark, got.astype(int)), {"x": 1, "y": 1}), ids.shape)
    assert np.array_equal(again[:10], ids[:10]) and np.array_equal(again[11:], ids[11:])


def test_eroded_objects(spark):
    rng = np.random.default_rng(4)
    labels = np.kron(rng.integers(0, 4, (3, 2, 2)), np.ones((5, 6, 5), int))
    for rounds, least in itertools.product((0, 1, 2, 3), (0, 40, 10_000)):
        want = np.zeros_like(labels)
        for v in np.unique(labels[labels > 0]):
            img = np.pad(labels == v, 1)
            for _ in range(rounds):
                less = img.copy()
                for axis in range(3):
                    less &= np.roll(img, 1, axis) & np.roll(img, -1, axis)
                if less.sum() < least:
                    break
                img = less
            want[img[1:-1, 1:-1, 1:-1]] = v
        assert np.array_equal(dense(D.eroded_objects(frame(spark, labels), rounds, least), labels.shape), want), (rounds, least)
