"""Stored arrays: layouts, pushed boxes, transactional writes."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import arrays as A

SHAPE, CHUNKS = (1, 5, 7, 9), (1, 2, 4, 4)


def volume(dtype="u2"):
    return (np.arange(np.prod(SHAPE)).reshape(SHAPE) * 7 % 1000).astype(dtype)


def made(tmp_path, layout="zarr", dtype="u2", **more):
    codec = {"precomputed": "raw", "n5": "gzip"}.get(layout, "zlib")
    return A.create_array(A.array_spec(f"{tmp_path}/a|{layout}:", ("c", "z", "y", "x"), SHAPE, CHUNKS, dtype, **({"codec": codec} | more)))


def dense(df, shape=SHAPE, origin=(0, 0, 0, 0), fill=-1):
    out = np.full(shape, fill, dtype=float)
    for r in df.collect():
        out[tuple(r[a] - o for a, o in zip("czyx", origin))] = r["v"]
    return out


def test_paths():
    assert A.parse_path("/a b/v.zip|zip:in/side|neuroglancer-precomputed:") == ("file:///a%20b/v.zip", [("zip", "in/side")], "neuroglancer_precomputed")
    for bad in ("/a", "file:///a|hdf5:", "/a|tar:x|zarr:"):
        with pytest.raises(ValueError):
            A.parse_path(bad)


@pytest.mark.parametrize("layout,codec", [("zarr", "zlib"), ("zarr", "raw"), ("zarr", "gzip"), ("zarr", "bz2"), ("zarr", "zstd"), ("n5", "gzip"), ("n5", "raw"), ("precomputed", "raw")])
def test_round_trip(spark, tmp_path, layout, codec):
    spec = made(tmp_path, layout, codec=codec)
    data = volume()
    assert A.write_array(A.from_numpy(spark, data), spec.path) == 3 * 2 * 3
    assert (dense(A.read_array(spark, spec.path)) == data).all()
    assert A.Files(spec.root).names(A.PENDING) == []


@pytest.mark.parametrize("dtype,kind", [("u1", "smallint"), ("i4", "int"), ("u8", "bigint"), ("f4", "float"), ("f8", "double"), ("b1", "boolean")])
def test_types(spark, tmp_path, dtype, kind):
    spec = made(tmp_path, dtype=dtype)
    A.write_array(A.from_numpy(spark, volume(dtype)), spec.path)
    got = A.read_array(spark, spec.path)
    assert dict(got.dtypes)["v"] == kind and (dense(got) == volume(dtype).astype(float)).all()


def test_zarr_files_as_others_write_them(spark, tmp_path):
    (tmp_path / "z").mkdir()
    (tmp_path / "z/.zarray").write_text(json.dumps({"zarr_format": 2, "shape": [3, 5], "chunks": [2, 4], "dtype": ">i2", "compressor": None, "fill_value": 9, "order": "F", "filters": None, "dimension_separator": "/"}))
    block = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], ">i2")
    (tmp_path / "z/0").mkdir()
    (tmp_path / "z/0/0").write_bytes(block.tobytes(order="F"))
    got = {(r["y"], r["x"]): r["v"] for r in A.read_array(spark, f"{tmp_path}/z|zarr:").collect()}
    assert got == {(y, x): int(block[y, x]) if y < 2 and x < 4 else 9 for y in range(3) for x in range(5)}
    skipped = A.read_array(spark, f"{tmp_path}/z|zarr:", absent="skip")
    assert skipped.count() == 8
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for f in (".zarray", "0/0"):
            z.write(tmp_path / "z" / f, f"in/{f}")
    assert A.read_array(spark, f"{tmp_path}/z.zip|zip:in|zarr:").agg(F.sum("v")).first()[0] == 36 + 9 * 7


def test_precomputed_offset(spark, tmp_path):
    spec = A.create_array(A.array_spec(f"{tmp_path}/p|precomputed:", ("c", "z", "y", "x"), (1, 2, 3, 4), (1, 2, 2, 2), "u1", codec="raw", origin=(0, 10, 20, 30)))
    data = np.arange(24).reshape(1, 2, 3, 4)
    rows = A.from_numpy(spark, data).select("c", (F.col("z") + 10).alias("z"), (F.col("y") + 20).alias("y"), (F.col("x") + 30).alias("x"), "v")
    A.write_array(rows, spec.path)
    assert (tmp_path / "p/0/30-32_20-22_10-12").exists() and (tmp_path / "p/0/32-34_22-23_10-12").exists()
    got = A.read_array(spark, spec.path)
    assert (dense(got, (1, 2, 3, 4), (0, 10, 20, 30)) == data).all()
    assert got.where("x >= 32 and y = 22 and z < 11").count() == 2


def parts_of(df):
    return df.rdd.getNumPartitions()


def test_filters_prune_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "PARTITION_BYTES", 1)  # a chunk a partition
    spec = made(tmp_path)
    A.write_array(A.from_numpy(spark, volume()), spec.path)
    reader = A.ArrayReader(spec, A.Box.whole(spec), True, "v")
    assert len(reader.partitions()) == 18
    left = list(reader.pushFilters([A.EqualTo(("z",), 3), A.GreaterThanOrEqual(("x",), 4), A.LessThan(("x",), 8), A.In(("y",), (5, 6)), A.GreaterThan(("v",), 3)]))
    assert [type(f).__name__ for f in left] == ["In", "GreaterThan"] and len(reader.partitions()) == 1
    df = A.read_array(spark, spec.path).where("z = 3 and x between 4 and 7 and y in (5, 6) and v > 3")
    want = {(3, y, x): int(volume()[0, 3, y, x]) for y in (5, 6) for x in range(4, 8) if volume()[0, 3, y, x] > 3}
    assert {(r["z"], r["y"], r["x"]): r["v"] for r in df.collect()} == want
    for name in (c for c in (tmp_path / "a").iterdir() if c.name[0].isdigit() and c.name != "0.1.1.1"):
        name.write_bytes(b"broken")  # a chunk that is read would fail
    assert df.count() == len(want)
    assert A.read_array(spark, spec.path, ((0, 3, 5, 4), (1, 4, 7, 8))).count() == 8
    assert A.read_array(spark, spec.path).where("x > 100").count() == 0


def test_partial_write_keeps_the_rest(spark, tmp_path):
    spec = made(tmp_path)
    data = volume()
    A.write_array(A.from_numpy(spark, data), spec.path)
    box = A.from_numpy(spark, data).where("z between 1 and 2 and x >= 6").withColumn("v", F.when(F.col("y") == 0, None).otherwise(F.col("v") + 1))
    assert A.write_array(box, spec.path) == 2 * 2 * 2
    want = data.astype(float)
    want[:, 1:3, :, 6:] += 1
    want[:, 1:3, 0, 6:] = 0
    assert (dense(A.read_array(spark, spec.path)) == want).all()
    with pytest.raises(Exception, match="outside"):
        A.write_array(A.from_numpy(spark, data).withColumn("x", F.col("x") + 1), spec.path)
    assert (dense(A.read_array(spark, spec.path)) == want).all() and A.recover(spec.path, discard=True) == []


def test_data_source_writer(spark, tmp_path):
    spec = made(tmp_path, "n5")
    A.register(spark)
    rows = A.from_numpy(spark, volume())
    sorted_rows = rows.withColumn("k", A.chunk_of(spec)).repartition(3, "k").sortWithinPartitions("k").drop("k")
    sorted_rows.write.format(A.SOURCE).option("path", spec.path).mode("append").save()
    assert (dense(A.read_array(spark, spec.path)) == volume()).all()
    with pytest.raises(Exception, match="several tasks"):
        rows.repartition(4).write.format(A.SOURCE).option("path", spec.path).mode("append").save()
    assert (dense(A.read_array(spark, spec.path)) == volume()).all() and A.Files(spec.root).names(A.PENDING) == []


def test_recovery(spark, tmp_path):
    spec = made(tmp_path)
    batch = next(A.voxel_batches(spec, spec.files(), (0, 0, 0, 0), A.Box.whole(spec), True, "v"))
    import pyarrow as pa

    batch = batch.set_column(4, "v", pa.array([5] * batch.num_rows, pa.int32()))
    attempt, chunks = A.stage(spec, iter([batch]), "job", "v")
    A.stage(spec, iter([batch]), "lost", "v")
    assert chunks == [0] and A.recover(spec.path) == [] and A.read_array(spark, spec.path).agg(F.sum("v")).first()[0] == 0
    A.Files(spec.root).put_whole(f"{A.PENDING}/job/committed", json.dumps([attempt]).encode())
    assert A.recover(spec.path, discard=True) == ["job"] and A.Files(spec.root).names(A.PENDING) == []
    assert A.read_array(spark, spec.path).agg(F.sum("v")).first()[0] == 5 * 32


def test_points(spark, tmp_path):
    spec = made(tmp_path)
    A.write_array(A.from_numpy(spark, volume()), spec.path)
    for name in ("0.0.0.0", "0.2.1.2"):
        (tmp_path / "a" / name).write_bytes(b"broken")
    points = [(i, 0, z, y, x) for i, (z, y, x) in enumerate([(0, 0, 4), (0, 0, 4), (3, 6, 8), (4, 0, 0), (9, 9, 9), (0, -1, 5)])]
    df = spark.createDataFrame(points, "id bigint, c bigint, z bigint, y bigint, x bigint")
    got = {r["id"]: r["v"] for r in A.read_points(spark, spec.path, df).collect()}
    assert got == {i: int(volume()[c, z, y, x]) if z < 5 and y >= 0 else None for i, c, z, y, x in points}


def test_create(tmp_path):
    spec = made(tmp_path)
    assert made(tmp_path) == spec
    with pytest.raises(ValueError):
        A.create_array(A.array_spec(spec.path, ("c", "z", "y", "x"), SHAPE, (1, 5, 7, 9), "u2"))
    (tmp_path / "a/0.0.0.0").write_bytes(b"x")
    A.create_array(spec, delete_existing=True)
    assert not (tmp_path / "a/0.0.0.0").exists()
    with pytest.raises(FileNotFoundError):
        A.open_array(f"{tmp_path}/none|zarr:")
