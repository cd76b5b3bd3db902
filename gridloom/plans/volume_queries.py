"""Queries of the voxel-wise and volume operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.operators import filters as N
from gridloom.operators import scalar as S
from gridloom.operators import volumes as V
from gridloom.plans.catalog import query
from gridloom.plans.views import VOX, extent, vox

R = "round({}, 6)"


def _simple(name: str, column, sql: str, out: str = "v") -> None:
    """A voxel-wise query: ``column`` of v against ``sql`` of v."""
    query(name, f"WITH {VOX} SELECT x, y, z, {sql} AS {out} FROM vox")(lambda s, d: vox(s, d).select("x", "y", "z", column(F.col("v")).alias(out)))


_small = lambda c: F.least(c, F.lit(255.0)).cast("smallint")
_SMALL = "CAST(least(round_even(v, 0), 255) AS SMALLINT)"
_simple("cast_rescale_u8", lambda c: S.cast_rescale(c / 500, "float", "uint8"), "CAST(least(greatest(round(v / 500 * 255), 0), 255) AS SMALLINT)")
_simple("cast_rescale_bool", lambda c: S.cast_rescale(c / 500, "float", "bool"), "v / 500 >= 0.5")
_simple("cast_rescale_u16", lambda c: S.cast_rescale(c / 500, "float", "uint16"), "CAST(least(greatest(round(v / 500 * 65535), 0), 65535) AS INTEGER)")
_simple("cast_plain_i16", lambda c: S.cast_rescale(c, "float", "int16", rescale=False), "CAST(floor(v) AS SMALLINT)")
_simple("clip", lambda c: S.clip(c, 10.0, 100.0), "least(greatest(v, 10.0), 100.0)")
_simple("clip_open", lambda c: S.clip(c, low=25.0), "greatest(v, 25.0)")
_simple("threshold", lambda c: S.threshold(c, 50.0), "CASE WHEN v > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
_simple("log1p", lambda c: F.round(F.log1p(c), 6), "round(ln(1 + v), 6)")
_simple("scale_values", lambda c: F.round(c * 2.5, 6), "round(v * 2.5::DOUBLE, 6)")
_simple("standardize", lambda c: F.round(S.standardize(c, 50.0, 49.0), 6), "round((v - 50) / 49, 6)")
_simple("rescale_values", lambda c: F.round(S.rescale(c, 0.0, 500.0, -1.0, 1.0), 6), "round(v / 500 * 2 - 1, 6)")
_simple("shift_and_divide", lambda c: F.round((c - 7.0) / 3.0, 6), "round((v - 7) / 3, 6)")
_simple("cosine_schedule", lambda c: F.round(S.cosine_ramp(c / 500, 2.0, 1.5), 6), "round(pow(abs(cos(pow(v / 500, 1.5) * pi() / 2)), 2), 6)")
_simple("log_snr_schedule", lambda c: F.round(S.linear_log_snr(c / 500), 6), "round(1 / (1 + exp(-(20 - 40 * v / 500))), 6)")
_simple("integer_division", lambda c: F.floor((c - 100) / 7), "CAST(floor((v - 100) / 7) AS BIGINT)")
_simple("coordinate_distance", lambda c: F.round(F.sqrt(F.pow(F.col("x") - 10, 2) + F.pow(F.col("y") - 5, 2)), 6), "round(sqrt(pow(x - 10, 2) + pow(y - 5, 2)), 6)", "distance")


@query("nan_replace", f"WITH {VOX} SELECT x, y, z, CASE WHEN id % 17 = 0 THEN -1.0::DOUBLE ELSE v END AS v FROM vox")
def nan_replace(spark, sf_dir):
    holed = vox(spark, sf_dir).withColumn("v", F.when(F.col("id") % 17 == 0, float("nan")).otherwise(F.col("v")))
    return holed.select("x", "y", "z", S.nan_replace(F.col("v"), -1.0).alias("v"))


@query("min_sum", f"""WITH {VOX} SELECT x, y, z, CASE WHEN sum(v) OVER (PARTITION BY z) < 19500 THEN 0.0::DOUBLE ELSE v END AS v FROM vox""")
def min_sum(spark, sf_dir):
    return V.min_sum(vox(spark, sf_dir), ["z"], 19500.0).select("x", "y", "z", "v")


@query("multiply_pointwise", f"WITH {VOX} SELECT a.x, a.y, a.z, round(a.v * b.v, 4) AS v FROM vox a JOIN vox b ON a.x = b.y AND a.y = b.x AND a.z = b.z")
def multiply_pointwise(spark, sf_dir):
    a = vox(spark, sf_dir).select("x", "y", "z", "v")
    turned = a.select(F.col("y").alias("x"), F.col("x").alias("y"), "z", "v")
    return S.multiply_pointwise(a, turned, ["x", "y", "z"]).withColumn("v", F.round("v", 4))


@query("df_over_f", f"""WITH {VOX}, f0 AS (SELECT x, y, min(v) AS v FROM vox GROUP BY x, y)
SELECT a.x, a.y, a.z, round((a.v - f0.v) / CASE WHEN f0.v - 0.42 = 0 THEN 1 ELSE f0.v - 0.42 END, 4) AS v FROM vox a JOIN f0 ON a.x = f0.x AND a.y = f0.y""")
def df_over_f(spark, sf_dir):
    a = vox(spark, sf_dir).select("x", "y", "z", "v")
    return S.delta_f_over_f(a, V.project(a, "z", "min"), ["x", "y"], 0.42).select("x", "y", "z", F.round("v", 4).alias("v"))


for _how, _sql in (("max", "max(v)"), ("min", "min(v)"), ("mean", "round(avg(v), 6)"), ("std", "round(stddev_pop(v), 6)"), ("sum", "round(sum(v), 4)")):

    def _project(spark, sf_dir, how=_how):
        digits = 4 if how == "sum" else 6
        return V.project(vox(spark, sf_dir), "z", how).select("x", "y", F.round("v", digits).alias("v"))

    query(f"proj_{_how}", f"WITH {VOX} SELECT x, y, {_sql} AS v FROM vox GROUP BY x, y")(_project)


@query("proj_max_infinite", f"WITH {VOX} SELECT y, z, max(CASE WHEN id % 23 = 0 THEN NULL WHEN id % 29 = 0 THEN 0 ELSE v END) AS v FROM vox GROUP BY y, z")
def proj_max_infinite(spark, sf_dir):
    odd = F.when(F.col("id") % 23 == 0, float("nan")).when(F.col("id") % 29 == 0, float("inf")).otherwise(F.col("v"))
    return V.project(vox(spark, sf_dir).withColumn("v", odd), "x", "max")


@query("zscore_axis", f"WITH {VOX} SELECT x, y, z, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 5) AS v FROM vox WINDOW w AS (PARTITION BY x, y)")
def zscore_axis(spark, sf_dir):
    return V.zscore(vox(spark, sf_dir), "z").select("x", "y", "z", F.round("v", 5).alias("v"))


@query("zscore_global", f"WITH {VOX} SELECT x, y, z, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 5) AS v FROM vox")
def zscore_global(spark, sf_dir):
    return V.zscore(vox(spark, sf_dir), None).select("x", "y", "z", F.round("v", 5).alias("v"))


_BLOCK = "x // 4 AS x, y // 2 AS y, z // 5 AS z"
for _how, _sql in (("mean", "round(avg(v), 6)"), ("min", "min(v)"), ("max", "max(v)"), ("median", "round(median(v), 6)")):

    def _down(spark, sf_dir, how=_how):
        return V.downsample(vox(spark, sf_dir), {"x": 4, "y": 2, "z": 5}, how).withColumn("v", F.round("v", 6))

    query(f"downsample_{_how}", f"WITH {VOX}, c AS (SELECT {_BLOCK}, v FROM vox) SELECT x, y, z, {_sql} AS v FROM c GROUP BY x, y, z")(_down)


@query("downsample_mode", f"""WITH {VOX}, c AS (SELECT {_BLOCK}, label, count(*) AS n FROM vox GROUP BY ALL)
SELECT x, y, z, label FROM (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY n DESC, label) AS k FROM c) WHERE k = 1""")
def downsample_mode(spark, sf_dir):
    return V.downsample(vox(spark, sf_dir), {"x": 4, "y": 2, "z": 5}, "mode", "label")


@query("downsample_stride", f"WITH {VOX} SELECT {_BLOCK}, v FROM vox WHERE x % 4 = 0 AND y % 2 = 0 AND z % 5 = 0")
def downsample_stride(spark, sf_dir):
    return V.downsample(vox(spark, sf_dir), {"x": 4, "y": 2, "z": 5}, "stride")


@query("downsample_area_masked", f"""WITH {VOX} SELECT (x - 2) // 4 AS x, y // 4 AS y, (z - 1) // 2 AS z, round_even(avg(CASE WHEN label <> 0 THEN CAST(v AS INTEGER) END), 0) AS v
FROM vox WHERE x >= 2 AND z >= 1 GROUP BY 1, 2, 3""")
def downsample_area_masked(spark, sf_dir):
    whole = vox(spark, sf_dir).withColumn("v", F.bround("v").cast("int"))
    return V.downsample_area(whole, (10, 20, 31), (4, 4, 2), masked=F.col("label") == 0)


@query("upsample_nearest", f"WITH {VOX} SELECT x * 2 + i AS x, y, z * 3 + j AS z, v FROM vox, range(2) a(i), range(3) b(j)")
def upsample_nearest(spark, sf_dir):
    return V.upsample(vox(spark, sf_dir).select("x", "y", "z", "v"), {"x": 2, "z": 3})


@query("multiscale_pyramid", f"""WITH {VOX} SELECT 0 AS level, x, y, z, max(v) AS v FROM vox GROUP BY ALL
UNION ALL SELECT 1, x // 2, y // 2, z, max(v) FROM vox GROUP BY ALL UNION ALL SELECT 2, x // 4, y // 4, z // 2, max(v) FROM vox GROUP BY ALL""")
def multiscale_pyramid(spark, sf_dir):
    return V.pyramid(vox(spark, sf_dir), [{"x": 2, "y": 2}, {"x": 4, "y": 4, "z": 2}], "max")


@query("subvolume_split", f"""WITH {VOX} SELECT CAST(floor((x - 3) / 7.0) AS BIGINT) AS cx, CAST(floor((y - 3) / 7.0) AS BIGINT) AS cy, CAST(floor(z / 4.0) AS BIGINT) AS cz,
  (x - 3 + 7) % 7 AS rx, (y - 3 + 7) % 7 AS ry, z % 4 AS rz, v FROM vox""")
def subvolume_split(spark, sf_dir):
    return V.split(vox(spark, sf_dir), (7, 7, 4), (3, 3, 0)).select("cx", "cy", "cz", "rx", "ry", "rz", "v")


@query("merge_where_empty", f"""WITH {VOX}, holed AS (SELECT x, y, z, CASE WHEN label = 0 THEN 0 ELSE v END AS v FROM vox) SELECT a.x, a.y, a.z, CASE WHEN a.v = 0 AND b.v IS NOT NULL THEN b.v ELSE a.v END AS v
FROM holed a LEFT JOIN vox b ON a.x = b.x + 3 AND a.y = b.y AND a.z = b.z""")
def merge_where_empty(spark, sf_dir):
    whole = vox(spark, sf_dir)
    holed = whole.select("x", "y", "z", F.when(F.col("label") == 0, 0.0).otherwise(F.col("v")).alias("v"))
    return V.merge_where_empty(holed, whole.select((F.col("x") + 3).alias("x"), "y", "z", "v"))


@query("index_dim", f"WITH {VOX}, i AS (SELECT unnest([4, 0, 4, 2]) AS v, unnest([0, 1, 2, 3]) AS i) SELECT x, y, CAST(i.i AS BIGINT) AS z, vox.v FROM vox JOIN i ON vox.z = i.v")
def index_dim(spark, sf_dir):
    return V.index_dim(vox(spark, sf_dir).select("x", "y", "z", "v"), "z", [4, 0, 4, 2])


@query("boundary_mask", f"WITH {VOX}, n AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM vox) SELECT x, y, z, x >= 2 AND x < nx - 1 AND y >= 0 AND y < ny - 3 AND z >= 1 AND z < nz - 1 AS mask FROM vox, n")
def boundary_mask(spark, sf_dir):
    whole = vox(spark, sf_dir)
    return V.boundary_mask(whole, extent(whole), (2, 0, 1), (1, 3, 1)).select("x", "y", "z", "mask")


@query("mask_combined", f"WITH {VOX} SELECT x, y, z, NOT (((v BETWEEN 20 AND 60) OR label IN (1, 3)) OR NOT (x + y > 12)) AS mask FROM vox")
def mask_combined(spark, sf_dir):
    v = F.col("v")
    mask = V.build_mask([([V.channel_mask(v, 20.0, 60.0), V.channel_mask(F.col("label"), values=[1, 3])], False), ([F.expr("x + y > 12")], True)], invert=True)
    return vox(spark, sf_dir).select("x", "y", "z", mask.alias("mask"))


@query("mask_range", f"WITH {VOX} SELECT x, y, z, v >= 30 AND v <= 90 AS mask FROM vox")
def mask_range(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", V.channel_mask(F.col("v"), 30.0, 90.0).alias("mask"))


@query("mask_values_inverted", f"WITH {VOX} SELECT x, y, z, label NOT IN (0, 2) AS mask FROM vox")
def mask_values_inverted(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", V.channel_mask(F.col("label"), values=[0, 2], invert=True).alias("mask"))


@query("mask_fov", f"""WITH {VOX} SELECT a.x, a.y, a.z, bool_or(b.v > 200) AS mask FROM vox a
JOIN vox b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 1 AND a.z = b.z GROUP BY a.x, a.y, a.z""")
def mask_fov(spark, sf_dir):
    return V.dilate(vox(spark, sf_dir).withColumn("mask", F.col("v") > 200), {"x": 2, "y": 1})


@query("integral_image", f"WITH {VOX} SELECT a.x, a.y, a.z, round(sum(b.v), 4) AS v FROM vox a JOIN vox b ON a.z = b.z AND b.x <= a.x AND b.y <= a.y GROUP BY a.x, a.y, a.z")
def integral_image(spark, sf_dir):
    return V.integral_image(vox(spark, sf_dir).select("x", "y", "z", "v")).withColumn("v", F.round("v", 4))


@query("box_sum", f"""WITH {VOX} SELECT a.x, a.y, a.z, round(sum(b.v), 4) AS v FROM vox a JOIN vox b ON a.z = b.z AND b.x BETWEEN a.x AND a.x + 2 AND b.y BETWEEN a.y AND a.y + 1
WHERE a.x <= 17 AND a.y <= 18 GROUP BY a.x, a.y, a.z""")
def box_sum(spark, sf_dir):
    whole = vox(spark, sf_dir).select("x", "y", "z", "v")
    return V.box_sums(V.integral_image(whole), 3, 2).withColumn("v", F.round("v", 4))


for _name, _filter, _sql in (
    ("moving_std", lambda d: N.box(d, {"x": 1, "y": 1}, "std"), "round(stddev_pop(b.v), 6)"),
    ("max_filter", lambda d: N.box(d, {"x": 1, "y": 1}, "max"), "round(max(b.v), 6)"),
    ("min_filter", lambda d: N.box(d, {"x": 1, "y": 1}, "min"), "round(min(b.v), 6)"),
    ("uniform_filter", lambda d: N.box(d, {"x": 1, "y": 1}, "mean"), "round(avg(b.v), 6)"),
    ("median_filter", lambda d: N.percentile(d, 1, 1, 0.5), "round(median(b.v), 6)"),
    ("percentile_filter", lambda d: N.percentile(d, 1, 1, 0.25), "round(quantile_cont(b.v, 0.25), 6)"),
):

    def _near(spark, sf_dir, run=_filter):
        return run(vox(spark, sf_dir)).select("x", "y", "z", F.round("v", 6).alias("v"))

    query(_name, f"WITH {VOX} SELECT a.x, a.y, a.z, {_sql} AS v FROM vox a JOIN vox b ON a.z = b.z AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y, a.z")(_near)


@query("laplacian", f"""WITH {VOX} SELECT x, y, z, round(coalesce(lag(v) OVER a, v) + coalesce(lead(v) OVER a, v) + coalesce(lag(v) OVER b, v) + coalesce(lead(v) OVER b, v) - 4 * v, 4) AS v
FROM vox WINDOW a AS (PARTITION BY y, z ORDER BY x), b AS (PARTITION BY x, z ORDER BY y)""")
def laplacian(spark, sf_dir):
    return V.laplacian(vox(spark, sf_dir)).select("x", "y", "z", F.round("v", 4).alias("v"))


@query("high_pass", f"""WITH {VOX} SELECT a.x, a.y, a.z, round(any_value(a.v) + min(255 - b.v), 4) AS v
FROM vox a JOIN vox b ON a.z = b.z AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y, a.z""")
def high_pass(spark, sf_dir):
    whole = vox(spark, sf_dir).select("x", "y", "z", "v")
    low = N.box(whole.withColumn("v", 255 - F.col("v")), {"x": 1, "y": 1}, "min").withColumnRenamed("v", "m")
    return whole.join(low, ["x", "y", "z"]).select("x", "y", "z", F.round(F.col("v") + F.col("m"), 4).alias("v"))


@query("objects_context", f"""WITH {VOX}, o AS (SELECT id AS object, x, y, z FROM vox)
SELECT o.object, i.i AS dx, j.j AS dy, k.k AS dz, coalesce(v.v, 0.0) AS v FROM o, (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS i) i, (SELECT CAST(unnest(range(-1, 2)) AS INTEGER) AS j) j, (SELECT CAST(unnest(range(-1, 1)) AS INTEGER) AS k) k
LEFT JOIN vox v ON v.x = o.x + i.i AND v.y = o.y + j.j AND v.z = o.z + k.k""")
def objects_context(spark, sf_dir):
    whole = vox(spark, sf_dir)
    return V.objects_context(whole, whole.select(F.col("id").alias("object"), "x", "y", "z"), (5, 3, 2))


@query("voxel_points_gather", f"WITH {VOX} SELECT v.id, v.v, label FROM vox v WHERE (x, y, z) IN ((1, 2, 3), (4, 4, 4), (19, 0, 9))")
def voxel_points_gather(spark, sf_dir):
    points = spark.createDataFrame([(1, 2, 3), (4, 4, 4), (19, 0, 9), (50, 50, 50)], "x bigint, y bigint, z bigint")
    return vox(spark, sf_dir).join(F.broadcast(points), ["x", "y", "z"]).select("id", "v", "label")  # a list of the caller's


@query("reshape_transpose", "SELECT vec_id, list_transform(range(1, 5), lambda j: list_transform(range(0, 3), lambda i: CAST(embedding[i * 4 + j] AS DOUBLE))) AS t FROM embeddings")
def reshape_transpose(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double"))
    return e.select("vec_id", S.reshape_array(first, 4).alias("m")).select("vec_id", S.transpose_array(F.col("m")).alias("t"))


@query("pad_and_clip_array", "SELECT vec_id, list_concat([0.0, 0.0], list_concat(list_transform(embedding[1:6], lambda x: least(greatest(CAST(x AS DOUBLE), -0.1::DOUBLE), 0.1::DOUBLE)), [0.0])) AS p FROM embeddings")
def pad_and_clip_array(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    return e.select("vec_id", S.pad_array(S.clip_outliers_in_array(first, -0.1, 0.1), 2, 1, 0.0).alias("p"))


_LOGITS = "list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE))"


@query("dempster_shafer", f"SELECT vec_id, round(10 / (10 + list_sum(list_transform({_LOGITS}, lambda x: exp(x)))), 6) AS u FROM embeddings")
def dempster_shafer(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.round(S.dempster_shafer(F.slice("embedding", 1, 10)), 6).alias("u"))


@query("adjusted_logits", f"""SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p FROM (SELECT vec_id, list_transform({_LOGITS}, lambda x: exp(x / sqrt(1 + {3 / math.pi**2} * 0.5))) AS e FROM embeddings)""")
def adjusted_logits(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 10).alias("l"))
    return e.select("vec_id", F.transform(S.adjusted_logits(F.col("l"), 0.5, 3 / math.pi**2), lambda x: F.round(x, 6)).alias("p"))
