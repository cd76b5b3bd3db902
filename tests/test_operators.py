"""Operators against small cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import specs
from gridloom.operators import boxes as B
from gridloom.operators import graphs as G
from gridloom.operators import metrics as M
from gridloom.operators import points as P
from gridloom.operators import sampling as A
from gridloom.operators import scalar as S
from gridloom.operators import segmentation as SEG
from gridloom.operators import timeseries as T
from gridloom.operators import volumes as V
from gridloom.sources import volumes as store
from gridloom.streaming import windows


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def plane(spark, rows):
    data = [(y * 100 + x, x, y, 0, v) for y, row in enumerate(rows) for x, v in enumerate(row)]
    kind = "double" if isinstance(rows[0][0], float) else "bigint"
    return spark.createDataFrame(data, f"id bigint, x bigint, y bigint, z bigint, v {kind}").withColumn("label", F.col("v").cast("bigint"))


def test_grid():
    g = B.Grid((0, 0, 0), (20, 20, 10), (15, 13, 6), (1, 2, 2))
    assert g.shape == (2, 2, 2) and g.index_of((1, 1, 1)) == 7
    with pytest.raises(ValueError):
        g.index_of((2, 0, 0))


def test_grid_boxes(spark):
    g = B.Grid((0, 0, 0), (20, 20, 10), (15, 13, 6), (1, 2, 2))
    by = {r["idx"]: r for r in g.boxes(spark).collect()}
    assert [by[1][c] for c in ("x0", "y0", "z0", "x1", "y1", "z1")] == [14, 0, 0, 20, 13, 6]
    assert [by[7][c] for c in ("x0", "y0", "z0", "x1", "y1", "z1")] == [14, 11, 4, 20, 20, 10]
    back = B.Grid((0, 0, 0), (20, 20, 10), (15, 13, 6), (1, 2, 2), back_shift=True)
    assert next((r["x0"], r["x1"]) for r in back.boxes(spark).collect() if r["idx"] == 1) == (5, 20)


def test_points_in_overlapping_boxes(spark):
    g = B.Grid((0, 0, 0), (40, 40, 40), (20, 20, 20), (10, 10, 10))
    pts = spark.createDataFrame([(1, 10, 0, 0), (2, 10, 30, 10), (3, 10, 40, 10), (4, 20, 10, 0)], "id int, x bigint, y bigint, z bigint")
    got = values(g.containing(pts), "id", "cx", "cy", "cz")
    assert [c[1:] for c in got if c[0] == 1] == [(0, 0, 0), (1, 0, 0)]
    assert [c[1:] for c in got if c[0] == 2] == [(0, 2, 0), (0, 2, 1), (1, 2, 0), (1, 2, 1)]
    assert not [c for c in got if c[0] == 3] and len([c for c in got if c[0] == 4]) == 4


def test_clamped_windows_and_percentiles(spark):
    rows = spark.createDataFrame([(1, 3, 100), (3, 3, 100), (50, 3, 100), (96, 3, 100), (98, 3, 100), (1, 3, 4)], "t bigint, r int, n bigint")
    s, e = T.clamped_window(F.col("t"), 3, F.col("n"))
    assert [tuple(r) for r in rows.select(s, e).collect()] == [(0, 7), (0, 7), (47, 54), (93, 100), (93, 100), (0, 4)]
    series = spark.createDataFrame([(k, t, float(3 * k + t)) for k in range(4) for t in range(3)], "k int, t bigint, v double")
    got = values(T.clamped_percentiles(series, ["k"], 1, [0.0, 0.5, 1.0]), "k", "t", "q", "v")
    assert all(v == 3 * k + 2 * q for k, t, q, v in got) and len(got) == 36


def test_evoked(spark):
    series = spark.createDataFrame([(0, t, float(t)) for t in range(10)], "k int, t bigint, v double")
    got = {r["phase"]: r["v"] for r in T.evoked_response(series, ["k"], [3, 3, 4], "left", subtract=False).collect()}
    assert np.allclose([got[p] for p in range(4)], [6, 10 / 3, 13 / 3, 16 / 3])
    flat = T.evoked_response(series, ["k"], []).collect()
    assert np.allclose(sorted(r["v"] for r in flat), np.arange(10) - 4.5)


def test_casts(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "v double")
    assert [r[0] for r in df.select(S.cast_rescale(F.col("v"), "float", "uint16")).collect()] == [0, 65535]
    assert [r[0] for r in df.select(S.cast_rescale(F.col("v") * 255, "uint8", "bool")).collect()] == [False, True]
    assert [r[0] for r in df.select(S.cast_rescale(F.col("v") * 255, "uint8", "int16")).collect()] == [0, 32767]
    with pytest.raises(TypeError):
        S.cast_rescale(F.lit(1), "float", "complex")


def test_nan_and_clip(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,), (-5.0,)], "v double")
    assert [r[0] for r in df.select(S.nan_replace(F.col("v"), 1.0)).collect()] == [1.0, 5.0, -5.0]
    got = [r[0] for r in df.select(S.clip(F.col("v"), -1.0, 1.0)).collect()]
    assert math.isnan(got[0]) and got[1:] == [1.0, -1.0]


def test_downsample_and_pyramid(spark):
    df = plane(spark, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])
    assert values(V.downsample(df, {"x": 2}, "mean"), "y", "x", "v") == [(0, 0, 1.5), (0, 1, 3.0), (1, 0, 4.5), (1, 1, 6.0)]
    four = plane(spark, [[float(4 * y + x) for x in range(4)] for y in range(4)])
    top = [r["v"] for r in V.pyramid(four, [{"x": 2, "y": 2}, {"x": 4, "y": 4}], "max").collect() if r["level"] == 2]
    assert top == [15.0]
    total = max(r["v"] for r in V.integral_image(plane(spark, [[1.0, 2.0], [3.0, 4.0]])).collect())
    assert total == 10.0


def test_components_and_relabel(spark):
    df = plane(spark, [[2, 2, 3, 4], [2, 3, 3, 2], [0, 0, 0, 2], [0, 3, 3, 3]])
    parts = {r["id"]: r["component"] for r in SEG.split_components(df).collect()}
    groups = {}
    for k, c in parts.items():
        groups.setdefault(c, set()).add(k)
    assert sorted(map(len, groups.values())) == [1, 2, 3, 3, 3]
    ids = spark.createDataFrame([(2 << 40,), (100000,), (30,)], "label bigint")
    assert values(SEG.make_contiguous(ids), "label", "new_id") == [(0, 0), (30, 1), (100000, 2), (2 << 40, 3)]
    with pytest.raises(Exception, match="no new id"):
        SEG.relabel(ids, spark.createDataFrame([(30, 1)], "label bigint, new_id bigint")).collect()
    assert values(SEG.region_adjacency(plane(spark, [[1, 1, 2], [3, 3, 2]])), "lo", "hi") == [(1, 2), (1, 3), (2, 3)]


def test_equivalence_of_labels(spark):
    pairs = lambda a, b: spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    same = lambda a, b: SEG.are_equivalent(pairs(a, b), "a", "b").first()[0]
    assert same([1, 1, 2, 3], [2, 2, 3, 4]) and not same([1, 2, 2, 3], [2, 2, 3, 4]) and not same([1, 1, 2, 3], [1, 2, 3, 4])


def test_fill_holes(spark):
    df = plane(spark, [[1] * 5, [1, 0, 0, 1, 1], [1, 1, 1, 2, 2], [1, 2, 0, 2, 2], [0, 2, 2, 2, 2]])
    flat = SEG.fill_holes(df.withColumn("z", F.lit(1)), (5, 5, 9))
    got = {r["id"]: r["label"] for r in flat.collect()}
    assert got[101] == got[102] == 1 and got[302] == 0 and got[400] == 0


def test_packed_ids(spark):
    blocks = G.Blocks((4, 4, 4), (2, 2, 2))
    assert blocks.bits == 2
    got = spark.range(1).select(blocks.base(F.lit(1 + 4 * (2 + 4 * 3)))).first()[0]
    assert got == 2**56 + 2**54 + 2 * 2**52 + 3 * 2**50


def test_graph_export(spark):
    labels = {0: [1, 2, 2, 3], 1: [4, 5, 5, 6]}
    vox = spark.createDataFrame([(x, y, 0, v) for y, row in labels.items() for x, v in enumerate(row)], "x bigint, y bigint, z bigint, label bigint")
    edges = spark.createDataFrame([(1, 2, 10.0), (4, 6, 11.0), (5, 6, 12.0), (3, 6, 13.0), (9, 1, 14.0)], "a bigint, b bigint, score double")
    blocks = G.Blocks((2, 1, 1), (2, 2, 1))
    assert blocks.bits == 1
    ids = G.supervoxel_ids(vox, blocks)
    out = G.block_edges(ids, edges, blocks)
    got = values(out.where("affinity < 1e300"), "block", "class", "a", "b", "affinity")
    assert (0, "in", 1, 2, 10.0) in got and (1, "in", 3, 6, 13.0) in got and (1, "in", 5, 6, 12.0) in got and (0, "between", 4, 6, 11.0) in got
    cross = values(out.where("class = 'cross'"), "block", "a")
    assert cross == [(0, 2), (0, 5), (1, 2), (1, 5)]
    assert values(G.dropped_edges(edges, out), "a", "b") == [(1, 9)]


def test_metrics(spark):
    truth, pred = "0110001111", "0010011110"
    df = spark.createDataFrame([(a == "1", b == "1") for a, b in zip(truth, pred, strict=True)], "t boolean, p boolean")
    r = M.confusion_bool(df, [], F.col("p"), F.col("t")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (4, 1, 2, 3)
    three = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (1, 1)], "t int, p int")
    by = {r["class"]: r for r in M.per_class(three, "p", "t").collect()}
    assert by[2]["precision"] == 0.5 and by[2]["recall"] == 1.0 and math.isclose(by[2]["f1"], 2 / 3)
    assert M.per_class(three.limit(0), "p", "t").count() == 0


def test_ball_query(spark):
    near = [(0, i, 0.1 * i, 0.0, 0.0) for i in range(4)] + [(0, 10 + i, 50.0 + 9 * i, 0.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(near, "cloud int, idx bigint, x double, y double, z double")
    got = [r for r in P.ball_query(df, 1.0, 10).collect() if r["i"] == 0]
    assert sorted(r["j"] for r in got) == [0, 1, 2, 3]
    picked = [r["idx"] for r in sorted(P.farthest_points(df, 3).collect(), key=lambda r: r["rank"])]
    assert picked[:2] == [0, 13]
    tree = P.spanning_tree(df).collect()
    assert len(tree) == 7 and math.isclose(sum(r["d"] for r in tree), 0.3 + 49.7 + 27)


def test_principal_axes_keep_distances(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3)) * [1, 5, 2]
    df = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(x)], "cloud int, idx bigint, x double, y double, z double")
    y = np.array([[r["x"], r["y"], r["z"]] for r in sorted(P.principal_axes(df).collect(), key=lambda r: r["idx"])])
    assert np.all(np.diff(y.var(0)) <= 1e-9) and np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x - x.mean(0), axis=1))


def test_lowpass_keeps_slow_waves(spark):
    t = np.arange(200)
    slow, fast = np.sin(t / 15), np.sin(t * 2.5)
    df = spark.createDataFrame([(0, int(i), float(v)) for i, v in enumerate(slow + fast)], "k int, t bigint, v double")
    got = np.array([r["v"] for r in sorted(P.lowpass(df, "k", 0.15).collect(), key=lambda r: r["t"])])
    assert np.abs(got - slow)[20:-20].max() < 0.1


def test_splits(spark):
    ids = spark.createDataFrame([(i, 1 if i < 3 else 2) for i in range(10)], "id bigint, label int")
    sizes = lambda df: {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    whole = A.stratified_split(ids.withColumn("label", F.lit(0)), "id", "label", [0.7, 0.1], ["train", "valid", "test"])
    assert sizes(whole) == {"train": 7, "valid": 1, "test": 2}
    assert sizes(A.stratified_split(ids, "id", "label", [0.7, 0.1], ["train", "valid", "test"])) == {"train": 6, "test": 4}
    turns = A.rotated(A.folds(ids, "id", "label", 5), 5)
    assert turns.where("split = 'valid'").groupBy("id").count().where("count <> 1").count() == 0
    assert values(A.concatenated([(ids.select("id"), 10), (ids.select("id"), 10)], "id"), "id")[-1] == (19,)
    with pytest.raises(ValueError):
        A.stratified_split(ids, "id", "label", [0.7], ["a"])


def test_specs(spark):
    assert specs.parse_args("a=1,flag,b=x", a=5, flag=False, b="y", c=2.5) == {"a": 1, "flag": True, "b": "x", "c": 2.5}
    assert specs.parse_args("128", size=(224, int), flag=False) == {"size": 128, "flag": False}
    assert specs.parse_args("flag", size=224, flag=False) == {"size": 224, "flag": True}
    assert specs.parse_args(None, size=224) == {"size": 224}
    assert specs.parse_args("a=3,b=x,c=False", lazy=True, a=1.0) == {"a": 3.0, "b": "x", "c": False}
    for wrong in ("a=1,z=2", "flag=maybe"):
        with pytest.raises(ValueError):
            specs.parse_args(wrong, a=1, flag=True)
    ops = {"f": None, "g": None}
    assert [x[1:] for x in specs.parse_chain("f(1, 'a|b', k=[1, -2.5e1, True]) | g", ops)] == [([1, "a|b"], {"k": [1, -25.0, True]}), ([], {})]
    for wrong in ("h()", "f(", "f(1", "f(x)", "f g", "f(1,,2)", "f(__import__('os'))", "f([1"):
        with pytest.raises(ValueError):
            specs.parse_chain(wrong, ops)
    assert specs.typed_sequence("1, 2.5,x") == [1, 2.5, "x"]
    assert specs.kebab_name("HTTPServerName") == "http-server-name" and specs.kebab_name("Foo2Bar") == "foo2bar"
    assert specs.typed_sequence("true,FALSE,1e3") == [True, False, 1000.0]
    ops = {"double": lambda df, by=2: df.withColumn("v", F.col("v") * by)}
    df = spark.createDataFrame([(3,)], "v int")
    assert specs.apply_chain(df, "double | double(by=5)", ops).first()[0] == 30
    for bad in ("nothing", "__import__('os')", "double(by=x)"):
        with pytest.raises(ValueError):
            specs.apply_chain(df, bad, ops)


def test_chunk_store(spark, tmp_path):
    vox = spark.createDataFrame([(x, y, z, float(x + 10 * y + 100 * z)) for x in range(7) for y in range(5) for z in range(4)], "x bigint, y bigint, z bigint, v double")
    chunks = store.to_chunks(vox, (3, 3, 2))
    assert values(store.from_chunks(chunks, (3, 3, 2)), "x", "y", "z", "v") == values(vox, "x", "y", "z", "v")
    path = f"{tmp_path}/vol"
    store.write_chunks(chunks.where("cx < 2"), path, resume=True)
    store.write_chunks(chunks, path, resume=True)
    there = spark.read.parquet(path)
    assert there.count() == chunks.count()
    assert store.read_range(there, (3, 3, 2), (2, 1, 1), (5, 4, 3)).count() == 3 * 3 * 2
    meta = store.VolumeMetadata("p", (8, 8, 4), (4.0, 4.0, 40.0), (4, 4, 2), channels=3, dtype="uint16")
    assert store.VolumeMetadata.from_json(meta.to_json()) == meta
    assert meta.scaled((0.5, 0.5, 1)).size == (4, 4, 4) and meta.scaled((0.5, 0.5, 1)).channels == 3


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", s % 2, float(s)) for s in range(40)]
    df = spark.createDataFrame(rows, "ts string, k int, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = windows.windowed_statistics(stream, "ts", "k", "v", "10 seconds", "10 seconds", "1 minute")
    q = out.writeStream.format("memory").queryName("stats").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = values(spark.table("stats"), "k", "n", "max")
    assert len(got) == 8 and sum(r[1] for r in got) == 40 and max(r[2] for r in got) == 39.0
