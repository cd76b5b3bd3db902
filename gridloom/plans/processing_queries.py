"""Queries of subvolume runs, proximity graphs, alignment and augmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import alignment as A
from gridloom.operators import augment as R
from gridloom.operators import boxes as B
from gridloom.operators import metrics as M
from gridloom.operators import proximity as P
from gridloom.operators import scalar as C
from gridloom.operators import segmentation as S
from gridloom.operators import subvolumes as U
from gridloom.operators import timeseries as T
from gridloom.operators import volumes as V
from gridloom.plans.catalog import query
from gridloom.plans.views import BOXES, SERIES, VOX, boxes, extent, series, table, vox
from gridloom.sources import volumes as store
from gridloom.sources.shared import shared_path

CHUNK = (8, 8, 4)


def _voxels(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", "v")


def _block_max(block: np.ndarray) -> np.ndarray:
    """The greatest of each voxel's 3 x 3 x 3 box."""
    for axis in range(3):
        wide = np.pad(block, [(1, 1) if a == axis else (0, 0) for a in range(3)], constant_values=-np.inf)
        n = block.shape[axis]
        block = np.maximum.reduce([np.take(wide, range(k, k + n), axis) for k in range(3)])
    return block


@query("subvolume_process", f"WITH {VOX} SELECT a.x, a.y, a.z, round(max(b.v), 6) AS v FROM vox a JOIN vox b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.id BETWEEN a.id - 421 AND a.id + 421 GROUP BY a.x, a.y, a.z")
def subvolume_process(spark, sf_dir):
    return U.process(_voxels(spark, sf_dir), CHUNK, (1, 1, 1), _block_max, float("-inf")).select("x", "y", "z", F.round("v", 6).alias("v"))


@query("subvolume_halo", f"""WITH {VOX}, h AS (SELECT x, y, z, unnest(range(CAST(floor((x - 2) / 8.0) AS BIGINT), CAST(floor((x + 2) / 8.0) AS BIGINT) + 1)) AS cx, unnest(range(0, 1)) AS o FROM vox),
i AS (SELECT x, y, z, cx, unnest(range(CAST(floor((y - 1) / 8.0) AS BIGINT), CAST(floor((y + 1) / 8.0) AS BIGINT) + 1)) AS cy FROM h WHERE cx BETWEEN 0 AND 2)
SELECT cx, cy, z // 4 AS cz, count(*) AS n, min(x) AS x0, max(x) + 1 AS x1 FROM i WHERE cy BETWEEN 0 AND 2 GROUP BY ALL""")
def subvolume_halo(spark, sf_dir):
    inside = vox(spark, sf_dir).select("x", "y", "z", F.lit(0.0).alias("v"))
    spread = U.with_halo(inside, CHUNK, (2, 1, 0)).groupBy("cx", "cy", "cz")
    return spread.agg(F.count("*").alias("n"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


_OPS = {
    "clip": lambda df, low, high: df.withColumn("v", C.clip(F.col("v"), low, high)),
    "down": lambda df, how, **factors: V.downsample(df, factors, how),
}


@query("materialized_run", f"WITH {VOX} SELECT x // 2 AS x, y // 2 AS y, z, max(least(greatest(v, 10.0), 90.0)) AS v FROM vox GROUP BY 1, 2, 3")
def materialized_run(spark, sf_dir):
    path = shared_path(spark, "run")
    half = _voxels(spark, sf_dir).where("z % 8 < 4")
    chain = "clip(10.0, high=90.0) | down('max', x=2, y=2)"
    U.materialize(half, chain, _OPS, path, CHUNK)  # a run that ended early; the next one adds what is missing
    return store.from_chunks(U.materialize(_voxels(spark, sf_dir), chain, _OPS, path, CHUNK), CHUNK)


@query("stored_range_read", f"WITH {VOX} SELECT x, y, z, v FROM vox WHERE x BETWEEN 3 AND 10 AND y BETWEEN 6 AND 19 AND z BETWEEN 2 AND 8")
def stored_range_read(spark, sf_dir):
    path = shared_path(spark, "chunks")
    store.write_chunks(store.to_chunks(_voxels(spark, sf_dir), CHUNK), path)
    return store.read_range(spark.read.parquet(path), CHUNK, (3, 6, 2), (11, 20, 9))


@query("stored_pyramid", f"""WITH {VOX} SELECT 0 AS level, x, y, z, v FROM vox UNION ALL SELECT 1, x // 2, y // 2, z, max(v) FROM vox GROUP BY ALL UNION ALL SELECT 2, x // 4, y // 4, z // 2, max(v) FROM vox GROUP BY ALL""")
def stored_pyramid(spark, sf_dir):
    levels = U.stored_pyramid(_voxels(spark, sf_dir), [{"x": 2, "y": 2}, {"x": 4, "y": 4, "z": 2}], lambda d, f: V.downsample(d, f, "max"), shared_path(spark, "pyramid"), CHUNK)
    out = [d.select(F.lit(k).alias("level"), "x", "y", "z", "v") for k, d in enumerate(levels)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("voxels_in_boxes", f"WITH {VOX} SELECT x, y, z, v FROM vox WHERE (x BETWEEN 2 AND 5 AND y < 4 AND z < 9) OR (x > 14 AND y BETWEEN 3 AND 11 AND z BETWEEN 5 AND 6)")
def voxels_in_boxes(spark, sf_dir):
    return U.in_any_box(_voxels(spark, sf_dir), [((2, 0, 0), (6, 4, 9)), ((15, 3, 5), (20, 12, 7))])


def _segments(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 40).alias("segment"), F.col("vec_id").alias("idx"), *[F.get("embedding", F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")])


@query("closest_segment_points", """WITH p AS (SELECT vec_id % 40 AS segment, vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
d AS (SELECT a.segment AS a, b.segment AS b, a.idx AS ia, b.idx AS ib, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2 FROM p a JOIN p b ON a.segment < b.segment)
SELECT a, b, round(d2, 9) AS d2, ia, ib FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d2, ia, ib) AS k FROM d WHERE d2 <= 0.01::DOUBLE) WHERE k = 1""")
def closest_segment_points(spark, sf_dir):
    return P.closest_pairs(_segments(spark, sf_dir), 0.1).withColumn("d2", F.round("d2", 9))


@query("segment_graph", """WITH RECURSIVE p AS (SELECT vec_id % 40 AS segment, vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
d AS (SELECT a.segment AS a, b.segment AS b, a.idx AS ia, b.idx AS ib, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2 FROM p a JOIN p b ON a.segment < b.segment),
e AS (SELECT *, row_number() OVER (ORDER BY d2, ia, ib) AS k FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d2, ia, ib) AS r FROM d) WHERE r = 1),
both_ways AS (SELECT a, b, k FROM e UNION ALL SELECT b, a, k FROM e),
grown AS (SELECT 1 AS n, [0] AS inside, CAST(NULL AS BIGINT) AS k UNION ALL
  SELECT n + 1, list_append(inside, arg_min(b, c)), min(c) FROM (SELECT g.n, g.inside, w.b, w.k AS c FROM grown g, both_ways w WHERE list_contains(g.inside, w.a) AND NOT list_contains(g.inside, w.b)) GROUP BY n, inside)
SELECT e.a, e.b, round(e.d2, 9) AS d2, e.ia, e.ib FROM grown JOIN e ON e.k = grown.k""")
def segment_graph(spark, sf_dir):
    return P.segment_graph(_segments(spark, sf_dir), 0.1).withColumn("d2", F.round("d2", 9))




@query("filtered_mask", f"""WITH RECURSIVE {VOX}, m AS (SELECT id, x, y, z FROM vox WHERE v > 90), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.id BETWEEN a.id - 400 AND a.id + 400),
r AS (SELECT id, id AS c FROM m UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a), p AS (SELECT id, min(c) AS c FROM r GROUP BY id), big AS (SELECT c FROM p GROUP BY c HAVING count(*) >= 3),
k AS (SELECT m.* FROM m JOIN p USING (id) JOIN big USING (c))
SELECT v.x, v.y, v.z, EXISTS (SELECT 1 FROM k WHERE k.z = v.z AND abs(k.x - v.x) <= 1 AND abs(k.y - v.y) <= 1) AS mask FROM vox v""")
def filtered_mask(spark, sf_dir):
    voxels = vox(spark, sf_dir).withColumn("label", (F.col("v") > 90).cast("bigint"))
    return S.filtered_mask(voxels, "area >= 3", {"x": 1, "y": 1})


@query("recomputed_components", f"""WITH RECURSIVE {VOX}, e AS (SELECT a.id AS a, b.id AS b FROM vox a JOIN vox b ON a.label = b.label AND a.label <> 0 AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.id BETWEEN a.id - 400 AND a.id + 400),
r AS (SELECT id, id AS c FROM vox WHERE label <> 0 UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a), p AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vox.id, CASE WHEN p.c IS NULL THEN 0 ELSE p.c + 1 + 5000000 END AS label FROM vox LEFT JOIN p USING (id)""")
def recomputed_components(spark, sf_dir):
    return S.recomputed_components(vox(spark, sf_dir), 5_000_000).select("id", "label")


@query("plane_ellipticity", f"""WITH {VOX}, o AS (SELECT user_id AS label, x, y FROM vox WHERE user_id > 0 AND z < 1000000), c AS (SELECT label, count(*) AS n, covar_samp(x, x) * covar_samp(y, y) - pow(covar_samp(x, y), 2) AS det FROM o GROUP BY label)
SELECT label, n, round(CASE WHEN det > 1e-12 THEN n / (4 * pi() * sqrt(det)) END, 5) AS ellipticity FROM c""")
def plane_ellipticity(spark, sf_dir):
    return S.ellipticity(vox(spark, sf_dir).withColumn("label", F.col("user_id")), axes="xy").withColumn("ellipticity", F.round("ellipticity", 5))


@query("mask_points", f"""WITH {VOX} SELECT id, x * 8.0::DOUBLE - (max(x) OVER () + 1) * 8.0::DOUBLE / 2 AS px, y * 8.0::DOUBLE - (max(y) OVER () + 1) * 8.0::DOUBLE / 2 AS py, z * 33.0::DOUBLE - (max(z) OVER () + 1) * 33.0::DOUBLE / 2 AS pz FROM (SELECT * FROM vox) q QUALIFY v > 150""")
def mask_points(spark, sf_dir):
    voxels = vox(spark, sf_dir)
    return S.mask_to_points(voxels.where("v > 150"), (8.0, 8.0, 33.0), extent(voxels)).select("id", "px", "py", "pz")


_UNITS = """e AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
g AS (SELECT id, CAST(k > 32 AS INTEGER) AS side, (k - 1) % 32 AS k, x FROM e), s AS (SELECT side, k, avg(x) AS m, stddev_pop(x) AS s FROM g GROUP BY ALL), z AS (SELECT id, side, k, (x - m) / s AS x FROM g JOIN s USING (side, k)),
n AS (SELECT id, side, sqrt(sum(x * x)) AS n FROM z GROUP BY ALL), u AS (SELECT id, side, k, x / n AS x FROM z JOIN n USING (id, side)),
rel AS (SELECT u.side, u.id, a.id AS anchor, sqrt(sum(pow(u.x - a.x, 2))) AS d FROM u JOIN u a ON u.side = a.side AND u.k = a.k AND a.id BETWEEN 1 AND 12 AND u.id > 12 GROUP BY ALL)"""


def _relative(spark, sf_dir, side):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1 + 32 * side, 32), lambda x: x.cast("double")).alias("vector"))
    units = A.standardized_units(e, "vector")
    anchors = units.where("id BETWEEN 1 AND 12").select(F.col("id").alias("anchor"), "vector")
    return A.distances_to_anchors(units.where("id > 12"), anchors), e


@query("anchor_distances", f"WITH {_UNITS} SELECT id, anchor, round(d, 6) AS d FROM rel WHERE side = 0")
def anchor_distances(spark, sf_dir):
    return _relative(spark, sf_dir, 0)[0].withColumn("d", F.round("d", 6))


@query("cross_modal_distance", f"""WITH {_UNITS}, q AS (SELECT side, anchor, avg(d) AS m, stddev_pop(d) AS s FROM rel GROUP BY ALL), sh AS (SELECT side, id, anchor, sign((d - m) / s) * pow(abs((d - m) / s), 2) AS e FROM rel JOIN q USING (side, anchor)),
l AS (SELECT side, id, sqrt(sum(e * e)) AS n FROM sh GROUP BY ALL), w AS (SELECT side, id, anchor, e / n AS e FROM sh JOIN l USING (side, id))
SELECT a.id AS a, b.id AS b, round(1 - sum(a.e * b.e), 6) AS distance FROM w a JOIN w b ON a.side = 0 AND b.side = 1 AND a.anchor = b.anchor AND b.id % 100 = 0 GROUP BY a.id, b.id""")
def cross_modal_distance(spark, sf_dir):
    first, second = (A.sharpened(_relative(spark, sf_dir, side)[0], 2.0) for side in (0, 1))
    return A.cross_distance(first, second.where("id % 100 = 0")).withColumn("distance", F.round("distance", 6))


@query("backprojection", f"""WITH {_UNITS}, w AS (SELECT id, anchor, 1 / pow(d, 4) AS w, max(1 / pow(d, 4)) OVER (PARTITION BY id) AS top FROM rel WHERE side = 1)
SELECT w.id, CAST(g.k AS INTEGER) AS k, round(sum(w * x) / sum(w), 6) AS v FROM w JOIN g ON g.id = w.anchor AND g.side = 0 WHERE w >= top / 2 GROUP BY w.id, g.k""")
def backprojection(spark, sf_dir):
    relative = _relative(spark, sf_dir, 1)[0]
    original = _relative(spark, sf_dir, 0)[1].where("id BETWEEN 1 AND 12").select(F.col("id").alias("anchor"), "vector")
    return A.backprojected(relative, original).withColumn("v", F.round("v", 6))


@query("dimension_correlation", """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(corr(a.x, b.x), 6) AS c FROM e a JOIN e b USING (vec_id) GROUP BY a.k, b.k""")
def dimension_correlation(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return A.product_matrix(vectors, "v").withColumn("c", F.round("c", 6))


def _u(seed: str, key: str = "user_id") -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("random_shift", f"WITH {VOX} SELECT id, CAST(x + floor({_u('shiftx')} * 9) - 4 AS BIGINT) AS x, CAST(y + floor({_u('shifty')} * 7) - 3 AS BIGINT) AS y, CAST(z + floor({_u('shiftz')} * 3) - 1 AS BIGINT) AS z FROM vox")
def random_shift(spark, sf_dir):
    return R.shifted(vox(spark, sf_dir), "user_id", (4, 3, 1)).select("id", "x", "y", "z")


@query("gray_augment", f"WITH {VOX} SELECT id, round(pow(greatest(least(v / 500 * ({_u('graya')} * (1.2::DOUBLE - 0.8::DOUBLE) + 0.8) + {_u('grayb')} * (0.1::DOUBLE + 0.1::DOUBLE) - 0.1, 1.0), 0.0), {_u('grayc')} * (1.4::DOUBLE - 0.7::DOUBLE) + 0.7), 6) AS v FROM vox")
def gray_augment(spark, sf_dir):
    return R.gray(vox(spark, sf_dir).withColumn("v", F.col("v") / 500), "user_id").select("id", F.round("v", 6).alias("v"))


@query("random_flip", f"WITH {VOX} SELECT id, CASE WHEN {_u('flipx')} < 0.5 THEN 19 - x ELSE x END AS x, CASE WHEN {_u('flipy')} < 0.5 THEN 19 - y ELSE y END AS y, CASE WHEN {_u('flipz')} < 0.5 THEN (SELECT max(z) FROM vox) - z ELSE z END AS z FROM vox")
def random_flip(spark, sf_dir):
    voxels = vox(spark, sf_dir)
    return R.flipped(voxels, "user_id", extent(voxels)).select("id", "x", "y", "z")


@query("random_permutation", f"WITH {VOX}, o AS (SELECT id, list_sort([{{'u': {_u('permutex')}, 'at': x}}, {{'u': {_u('permutey')}, 'at': y}}, {{'u': {_u('permutez')}, 'at': z}}]) AS o FROM vox) SELECT id, o[1].at AS x, o[2].at AS y, o[3].at AS z FROM o")
def random_permutation(spark, sf_dir):
    return R.permuted(vox(spark, sf_dir), "user_id").select("id", "x", "y", "z")


@query("downsampled_rows", f"SELECT doc_id FROM labels ORDER BY {_u('subset', 'doc_id')}, doc_id LIMIT 50")
def downsampled_rows(spark, sf_dir):
    return R.subset(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 50)


@query("subsampled_points", f"SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {_u('subset', 'vec_id')}, vec_id) AS k FROM embeddings) WHERE k <= 7")
def subsampled_points(spark, sf_dir):
    return R.subset(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 7, within=["label"]).select("vec_id")


@query("key_channels", f"WITH {VOX} SELECT id, [CAST(CASE WHEN label > 2 THEN v ELSE 0 END AS FLOAT), CAST(label > 2 AS FLOAT), CAST(v AS FLOAT)] AS channels FROM vox")
def key_channels(spark, sf_dir):
    return vox(spark, sf_dir).select("id", R.key_channels(F.col("v"), (F.col("label") > 2).cast("int"), ["masked_em", "seg", "em"]).alias("channels"))


@query("padded_batches", "WITH b AS (SELECT unnest(range((SELECT (count(*) - 1) // 64 + 1 FROM events))) AS batch), p AS (SELECT batch, CAST(unnest(range(64)) AS INTEGER) AS place FROM b) SELECT batch, place, coalesce(value, 0.0::DOUBLE) AS v FROM p LEFT JOIN events ON event_id = batch * 64 + place")
def padded_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("v"))
    return R.padded_batches(rows, "event_id", 64)


@query("box_relative", f"WITH {BOXES} SELECT id, {', '.join(f'{a}{e} - {o} AS {a}{e}' for a, o in zip('xyz', (5, 3, 2), strict=True) for e in (0, 1))} FROM boxes")
def box_relative(spark, sf_dir):
    return B.relative(boxes(spark, sf_dir), (5, 3, 2))


@query("box_slices", f"WITH {BOXES} SELECT id, concat_ws(',', {', '.join(f"{a}0 || ':' || {a}1" for a in 'xyz')}) AS slices FROM boxes")
def box_slices(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", B.slices().alias("slices"))


@query("box_from_slices", f"WITH {BOXES} SELECT id, x0, y0, z0, x1, y1, z1 FROM boxes")
def box_from_slices(spark, sf_dir):
    return B.from_slices(boxes(spark, sf_dir).select("id", B.slices().alias("slices")), "slices").select("id", "x0", "y0", "z0", "x1", "y1", "z1")


@query("box_from_json", f"WITH {BOXES} SELECT id, x0, y0, z0, x1, y1, z1 FROM boxes")
def box_from_json(spark, sf_dir):
    return B.from_json(boxes(spark, sf_dir).select("id", B.to_json().alias("j")), "j").select("id", "x0", "y0", "z0", "x1", "y1", "z1")


@query("correlate_with_center", f"WITH {SERIES}, r AS (SELECT t, v FROM series WHERE user_id = (SELECT CAST((min(user_id) + max(user_id) + 1) // 2 AS BIGINT) FROM series)) SELECT s.user_id, round(corr(s.v, r.v), 5) AS r FROM series s JOIN r ON s.t = r.t GROUP BY s.user_id")
def correlate_with_center(spark, sf_dir):
    return T.correlate_with_center(series(spark, sf_dir), "user_id").withColumn("r", F.round("r", 5))


for _name, _sql in (
    ("linear", "v / 500"),
    ("cosine", "pow(abs(cos(v / 500 * pi() / 2)), 1)"),
    ("cosine_2", "pow(abs(cos(v / 500 * pi() / 2)), 2)"),
    ("cosine_2_1.5", "pow(abs(cos(pow(v / 500, 1.5) * pi() / 2)), 2)"),
    ("linear_logsnr", "1 / (1 + exp(-(20 - 40 * v / 500)))"),
    ("linear_logsnr_-5_5", "1 / (1 + exp(-(5 - 10 * v / 500)))"),
):

    def _schedule(spark, sf_dir, name=_name):
        return vox(spark, sf_dir).select("id", F.round(C.schedule(F.col("v") / 500, name), 6).alias("v"))

    query(f"schedule_{_name}", f"WITH {VOX} SELECT id, round({_sql}, 6) AS v FROM vox")(_schedule)


@query("joined_names", "SELECT o_orderkey, concat_ws('_', o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)) AS name FROM orders")
def joined_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("_", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).alias("name"))


@query("combine_map", "SELECT vec_id, vec_id % 500 // 25 AS sample FROM embeddings")
def combine_map(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", C.combine_map(F.col("vec_id") % 500, 20, 500).alias("sample"))


@query("counted_weights", "SELECT user_id, count(*) FILTER (WHERE value > 60) AS n, CAST(count(*) FILTER (WHERE value > 60 AND event_type = 'view') AS BIGINT) AS hits FROM events GROUP BY user_id")
def counted_weights(spark, sf_dir):
    w = M.nonzero_weight(F.greatest(F.col("value") - 60, F.lit(0.0)))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(w).alias("n"), F.sum(w * (F.col("event_type") == "view").cast("bigint")).alias("hits"))


@query("vector_sums", "WITH l AS (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, k, round(sum(x), 5) AS v, count(*) AS n FROM l GROUP BY label, k")
def vector_sums(spark, sf_dir):
    return M.vector_sums(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("v", F.round("v", 5))


@query("value_range", "WITH l AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT k, min(x) AS low, max(x) AS high FROM l GROUP BY k")
def value_range(spark, sf_dir):
    return M.value_range(table(spark, sf_dir, "embeddings"), "embedding")


@query("feature_regression", """WITH l AS (SELECT label, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS p, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS t FROM embeddings)
SELECT label, round(avg(list_sum(list_transform(range(1, 33), lambda i: pow(p[i] - t[i], 2))) / 32), 6) AS mse, round(avg(list_cosine_similarity(p, t)), 6) AS cosine, round(avg(sqrt(list_sum(list_transform(p, lambda x: x * x)))), 6) AS predicted_norm, round(avg(sqrt(list_sum(list_transform(t, lambda x: x * x)))), 6) AS target_norm FROM l GROUP BY label""")
def feature_regression(spark, sf_dir):
    half = lambda k: F.transform(F.slice("embedding", k, 32), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("label", half(1).alias("p"), half(33).alias("t"))
    out = M.feature_regression(rows, ["label"], "p", "t")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("mse", "cosine", "predicted_norm", "target_norm")])


@query("expanded_dims", "SELECT vec_id, [list_transform(embedding, lambda x: CAST(x AS DOUBLE))] AS v FROM embeddings")
def expanded_dims(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
