"""Chains from array to array: footprints, resumed runs, descriptors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.specs import merged_spec, object_bounds
from gridloom.operators import registry as R
from gridloom.operators import runs
from gridloom.sources import arrays as A

SHAPE = (6, 13, 17)  # z, y, x
XYZ = (17, 13, 6)
CHAINS = [
    "clip(10.0, high=80.0) | gaussian(x=1.0, z=0.6, truncate=2.0)",
    "box('max', x=1, y=2) | down('mean', x=2, y=2)",
    "median(x=1, y=1) | up(x=2) | crop([3, 1, 0], [20, 9, 5])",
    "zscore('z') | scale(2.0)",
    "project('y', 'max') | unsharp(x=0.5)",
    "box('std', x=2, y=1, z=1) | local_rank(1) | standardize(3.0, 2.0)",
]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    spec = A.create_array(A.array_spec(f"{tmp_path_factory.mktemp('runs')}/in|zarr:", ("z", "y", "x"), SHAPE, (2, 4, 5), "f8"))
    data = np.random.default_rng(5).integers(0, 100, SHAPE).astype(float)
    A.write_array(A.from_numpy(spark, data, ("z", "y", "x")), spec.path)
    return spec


def values(df):
    return {(r["x"], r["y"], r["z"]): round(r["v"], 6) for r in df.collect()}


def whole(spark, source, chain):
    steps = R.build(chain, XYZ)
    rows = A.read_array(spark, source.path)
    return values(R.apply(rows, steps))


@pytest.mark.parametrize("chain", CHAINS)
def test_resumed_run_equals_whole_run(spark, source, tmp_path, chain):
    want = whole(spark, source, chain)
    target = f"{tmp_path}/out|zarr:"
    over = {"chunks": [2, 4, 4], "codec": "gzip"}
    first = runs.run_chain(spark, source.path, chain, target, over)
    assert values(A.read_array(spark, target)) == want and first.missing == first.chunks
    again = runs.run_chain(spark, source.path, chain, target, over)
    assert (again.missing, again.pieces, again.read) == (0, 0, 0)
    spec = A.open_array(target)
    gone = [k for k in range(first.chunks) if k % 5 == 1]
    for k in gone:
        (tmp_path / "out" / spec.key(spec.index(k))).unlink()
    third = runs.run_chain(spark, source.path, chain, target, over)
    assert third.missing == len(gone) and values(A.read_array(spark, target)) == want
    log = json.loads((tmp_path / "out/materialize_log.json").read_text())
    assert log["chain"] == chain and log["missing"] == len(gone)


def test_resumed_run_opens_needed_chunks_only(spark, tmp_path, source):
    target = f"{tmp_path}/out|zarr:"
    chain = "gaussian(x=0.5, truncate=2.0)"  # reaches one voxel along x
    runs.run_chain(spark, source.path, chain, target)
    want = values(A.read_array(spark, target))
    spec = A.open_array(target)
    (tmp_path / "out" / spec.key((0, 1, 1))).unlink()
    # A copy of the input of which all chunks but the needed ones are broken.
    copy = A.create_array(A.with_shape(source, f"{tmp_path}/copy|zarr:"))
    needed = {(0, 1, 0), (0, 1, 1), (0, 1, 2)}
    for k in range(int(np.prod(source.grid))):
        index = source.index(k)
        data = source.files().get(source.key(index))
        A.Files(copy.root).put(copy.key(index), data if index in needed else b"broken")
    report = runs.run_chain(spark, copy.path, chain, target)
    assert (report.missing, report.pieces, report.read) == (1, 1, 3)
    assert values(A.read_array(spark, target)) == want


def test_whole_volume_operator_writes_missing_only(spark, source, tmp_path):
    target = f"{tmp_path}/out|zarr:"
    runs.run_chain(spark, source.path, "zscore()", target)
    want = values(A.read_array(spark, target))
    spec = A.open_array(target)
    (tmp_path / "out" / spec.key((1, 0, 0))).unlink()
    (tmp_path / "out" / spec.key((0, 0, 0))).write_bytes(spec.pack((0, 0, 0), np.full((2, 4, 5), 7.0)))
    report = runs.run_chain(spark, source.path, "zscore()", target)
    got = values(A.read_array(spark, target))
    assert report.missing == 1 and report.read is None
    assert {k: v for k, v in got.items() if not (k[0] < 5 and k[1] < 4 and k[2] < 2)} == {k: v for k, v in want.items() if not (k[0] < 5 and k[1] < 4 and k[2] < 2)}
    assert got[0, 0, 0] == 7.0  # what was there stays


def test_zero_chunks_count_as_missing(spark, source, tmp_path):
    target = f"{tmp_path}/out|zarr:"
    runs.run_chain(spark, source.path, "clip(1.0)", target)
    want = values(A.read_array(spark, target))
    spec = A.open_array(target)
    (tmp_path / "out" / spec.key((1, 1, 1))).write_bytes(spec.pack((1, 1, 1), np.zeros((2, 4, 5))))
    assert runs.run_chain(spark, source.path, "clip(1.0)", target).missing == 0
    assert runs.run_chain(spark, source.path, "clip(1.0)", target, nonzero=True).missing == 1
    assert values(A.read_array(spark, target)) == want


def test_channels_types_and_errors(spark, tmp_path):
    data = np.arange(2 * 2 * 3 * 4).reshape(2, 2, 3, 4)
    spec = A.create_array(A.array_spec(f"{tmp_path}/c|n5:", ("c", "z", "y", "x"), data.shape, (1, 2, 2, 2), "u1", codec="gzip"))
    A.write_array(A.from_numpy(spark, data), spec.path)
    runs.run_chain(spark, spec.path, "scale(0.5)", f"{tmp_path}/d|zarr:", {"dtype": "i2", "codec": "zlib"}, channel=1)
    got = {(r["x"], r["y"], r["z"]): r["v"] for r in A.read_array(spark, f"{tmp_path}/d|zarr:").collect()}
    assert got == {(x, y, z): round(data[1, z, y, x] * 0.5) for x in range(4) for y in range(3) for z in range(2)}
    with pytest.raises(ValueError, match="exceeds"):
        runs.run_chain(spark, spec.path, "", f"{tmp_path}/e|zarr:", max_chunk_bytes=3)
    with pytest.raises(ValueError, match="channel"):
        runs.run_chain(spark, spec.path, "", f"{tmp_path}/e|zarr:", channel=2)
    for bad in ("nothing()", "clip(1, 2, 3)", "crop([0, 0, 0], [9, 9, 9])", '[{"name": "nothing"}]'):
        with pytest.raises(ValueError):
            R.build(bad, (4, 3, 2))


def test_pyramid(spark, source, tmp_path):
    first = runs.run_pyramid(spark, source.path, f"{tmp_path}/p", [(2, 2, 1), (2, 1, 2)], "max")
    assert [r.missing for r in first] == [r.chunks for r in first]
    rows = A.read_array(spark, source.path)
    want = values(rows.groupBy(*[F.floor(F.col(a) / f).alias(a) for a, f in zip("xyz", (4, 2, 2))]).agg(F.max("v").alias("v")))
    assert values(A.read_array(spark, f"{tmp_path}/p/s2|zarr:")) == want
    assert json.loads((tmp_path / "p/attributes.json").read_text())["scales"][2] == {"path": "s2", "downsample_factors": [4, 2, 2]}
    assert [r.missing for r in runs.run_pyramid(spark, source.path, f"{tmp_path}/p", [(2, 2, 1), (2, 1, 2)], "max")] == [0, 0, 0]


def test_described(spark, source):
    chain = [{"name": "box", "args": {"how": "mean", "x": 1, "z": 1}}, {"name": "down", "args": {"how": "max", "y": 3}}]
    d = json.dumps({"source": source.path, "chain": chain})
    want = values(runs.open_described(spark, d))
    assert len(want) == 17 * 5 * 6
    box = ((4, 9), (1, 3), (2, 4))
    assert values(runs.open_described(spark, d, box)) == {k: v for k, v in want.items() if all(lo <= c < hi for c, (lo, hi) in zip(k, box))}
    assert R.input_box(R.build(chain, XYZ), box) == ((3, 10), (3, 9), (1, 5))


def test_expand_and_specs():
    assert R.expand(((2, 5), (0, 4)), (3, 1), (1, 2), (5, 9)) == (((0, 5), (0, 6)), ((1, 1), (1, 0)))
    assert R.expand(((2, 5),), (1,), (9,)) == (((1, 14),), ((0, 0),))
    for bad in (((0, 1),), (-1,), (0,), None), (((0, 1),), (1, 2), (0,), None):
        with pytest.raises(ValueError):
            R.expand(*bad)
    base = {"a": 1, "b": {"c": 2, "d": 3}, "e": 4}
    over = {"a": "CLEAR", "b": {"c": "CLOBBER_WITH_INPUT_SPEC", "x": {"y": 1}}, "e": "CLOBBER_WITH_INPUT_SPEC", "f": 5}
    assert merged_spec(base, over, {"b": {"c": 9}}) == {"b": {"c": 9, "d": 3, "x": {"y": 1}}, "e": 4, "f": 5}
    assert base == {"a": 1, "b": {"c": 2, "d": 3}, "e": 4}
    assert object_bounds([[1, "2:4"], [slice(0, 3), "5"], ["1:9:2", ":3"]]) == [(slice(1, 2), slice(2, 4)), (slice(0, 3), slice(None, 5)), (slice(1, 9, 2), slice(None, 3))]
    with pytest.raises(ValueError):
        object_bounds([[1.5]])
