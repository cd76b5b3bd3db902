"""Queries of the neighbourhood filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import filters as N
from gridloom.operators import segmentation as S
from gridloom.plans.catalog import query
from gridloom.plans.views import VOX, extent, vox


def _voxels(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", "v")


def _rounded(df, digits=6):
    return df.select("x", "y", "z", F.round("v", digits).alias("v"))


def _smooth_sql(source: str, target: str, axis: str, sigma: float) -> str:
    """CTEs that smooth ``source`` along ``axis`` into ``target``."""
    others = ", ".join(a for a in "xyz" if a != axis)
    weights = N.gaussian_weights(sigma)
    w = f"[{', '.join(repr(x) for x in weights)}]"
    m = "((i + d) % (2 * n) + 2 * n) % (2 * n)"
    return f"""l_{target} AS (SELECT {others}, list(v ORDER BY {axis}) AS l, count(*) AS n FROM {source} GROUP BY {others}),
i_{target} AS (SELECT *, unnest(range(0, n)) AS i FROM l_{target}),
{target} AS (SELECT {others}, i AS {axis}, list_sum(list_transform(range({1 - len(weights)}, {len(weights)}), lambda d: {w}[CAST(abs(d) + 1 AS BIGINT)] * l[CAST(CASE WHEN {m} < n THEN {m} + 1 ELSE 2 * n - {m} END AS BIGINT)])) AS v FROM i_{target})"""


_SMOOTH = f"WITH {VOX}, {_smooth_sql('vox', 'gx', 'x', 1.0)}, {_smooth_sql('gx', 'gy', 'y', 0.7)}"


@query("gaussian_filter", f"{_SMOOTH} SELECT x, y, z, round(v, 6) AS v FROM gy")
def gaussian_filter(spark, sf_dir):
    return _rounded(N.gaussian(_voxels(spark, sf_dir), {"x": 1.0, "y": 0.7}))


@query("unsharp_mask", f"{_SMOOTH} SELECT x, y, z, round(vox.v + 1.5 * (vox.v - gy.v), 5) AS v FROM vox JOIN gy USING (x, y, z)")
def unsharp_mask(spark, sf_dir):
    return _rounded(N.unsharp_mask(_voxels(spark, sf_dir), {"x": 1.0, "y": 0.7}, 1.5), 5)


@query("peak_filter", f"""WITH {VOX} SELECT a.x, a.y, a.z, any_value(a.v) = max(b.v) AND any_value(a.v) > 100 AND a.x BETWEEN 1 AND 18 AND a.y BETWEEN 1 AND 18 AS peak
FROM vox a JOIN vox b ON a.z = b.z AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.x, a.y, a.z""")
def peak_filter(spark, sf_dir):
    voxels = _voxels(spark, sf_dir)
    return N.peaks(voxels, 2, 100.0, 1, extent(voxels))


for _how, _args, _sql in (
    ("gamma", {"gamma": 0.8}, "pow(v / 500, 0.8) * 500"),
    ("log", {"gain": 0.9}, "log2(1 + v / 500) * 500 * 0.9"),
    ("sigmoid", {"gain": 10.0, "cutoff": 0.2}, "500 / (1 + exp(10 * (0.2 - v / 500)))"),
):

    def _exposed(spark, sf_dir, how=_how, args=_args):
        return _rounded(_voxels(spark, sf_dir).withColumn("v", N.exposure(F.col("v"), how, 500.0, **args)), 5)

    query(f"exposure_{_how}", f"WITH {VOX} SELECT x, y, z, round({_sql}, 5) AS v FROM vox")(_exposed)


@query("exposure_equalize", f"""WITH {VOX}, b AS (SELECT *, greatest(least(CAST(floor(v / 400 * 128) AS BIGINT), 127), 0) AS b FROM vox), h AS (SELECT b, count(*) AS n FROM b GROUP BY b),
s AS (SELECT b, sum(n) OVER (ORDER BY b) / sum(n) OVER () AS s FROM h) SELECT x, y, z, round(s, 6) AS v FROM b JOIN s USING (b)""")
def exposure_equalize(spark, sf_dir):
    return _rounded(N.equalized(_voxels(spark, sf_dir), 0.0, 400.0, 128))


_BESIDE = "unnest([greatest(least(CAST(floor({f}) AS BIGINT), {last}), 0), greatest(least(CAST(floor({f}) AS BIGINT) + 1, {last}), 0)]) AS t{a}, unnest([1 - ({f} - floor({f})), {f} - floor({f})]) AS w{a}"


@query("clahe", f"""WITH {VOX}, p AS (SELECT x, y, z, greatest(least(CAST(floor(v / 255.0 * 32) AS BIGINT), 31), 0) AS b FROM vox),
h AS (SELECT z, x // 5 AS tx, y // 4 AS ty, b, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT z, tx, ty, sum(n) AS total, greatest(0.1 * sum(n), 1.0) AS lim FROM h GROUP BY ALL),
o AS (SELECT a.z, a.tx, a.ty, any_value(total) AS total, any_value(lim) AS lim, sum(greatest(n - lim, 0.0)) AS over FROM a JOIN h ON a.z = h.z AND a.tx = h.tx AND a.ty = h.ty GROUP BY ALL),
m AS (SELECT o.z, o.tx, o.ty, k.k, (coalesce((SELECT sum(least(h.n, o.lim)) FROM h WHERE h.z = o.z AND h.tx = o.tx AND h.ty = o.ty AND h.b <= k.k), 0) + (k.k + 1) * over / 32.0) / total * 255 AS c FROM o, (SELECT unnest(range(32)) AS k) k),
n1 AS (SELECT x, y, z, b, {_BESIDE.format(f='((x - 2.0::DOUBLE) / 5.0::DOUBLE)', last=3, a='x')} FROM p), n2 AS (SELECT *, {_BESIDE.format(f='((y - 1.5::DOUBLE) / 4.0::DOUBLE)', last=4, a='y')} FROM n1)
SELECT x, y, z, round(sum(wx * wy * c), 5) AS v FROM (SELECT x, y, n2.z, wx, wy, c FROM n2 JOIN m ON m.z = n2.z AND m.tx = n2.tx AND m.ty = n2.ty AND m.k = n2.b) GROUP BY x, y, z""")
def clahe(spark, sf_dir):
    voxels = _voxels(spark, sf_dir)
    return _rounded(N.clahe(voxels, (5, 4), extent(voxels), 0.1, 32), 5)


@query("local_rank", f"""WITH {VOX} SELECT a.x, a.y, a.z, round(255.0 * count(*) FILTER (WHERE b.v <= a.v) / count(*), 6) AS v FROM vox a
JOIN vox b ON a.z = b.z AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 9 GROUP BY a.x, a.y, a.z""")
def local_rank(spark, sf_dir):
    return _rounded(N.local_rank(_voxels(spark, sf_dir), 3))


@query("contrast_limited", f"""WITH {VOX}, s AS (SELECT a.x, a.y, a.z, any_value(a.v) / 255 AS v, avg(b.v / 255) AS m, stddev_samp(b.v / 255) AS d, count(*) AS n FROM vox a JOIN vox b ON a.z = b.z AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.x, a.y, a.z),
k AS (SELECT *, CASE WHEN 1 / (3 * d) >= 1.5 THEN pow(1 / (3 * d) + 0.25 - 1.5, 0.5) + 1.5 - 0.5 ELSE 1 / (3 * d) END AS s FROM s)
SELECT x, y, z, CAST(CASE WHEN n = 25 THEN floor(greatest(least((v - (m - 1 / s)) * s * 0.5 * 255, 255.0), 0.0)) ELSE 0 END AS INTEGER) AS v FROM k""")
def contrast_limited(spark, sf_dir):
    return N.contrast_limited(_voxels(spark, sf_dir), 2, 3.0, 1.5)


@query("interpolate_axis", f"""WITH {VOX}, l AS (SELECT y, z, list(v ORDER BY x) AS l, count(*) AS n FROM vox GROUP BY y, z), i AS (SELECT y, z, l, n, unnest(range(0, 33)) AS x FROM l), p AS (SELECT *, x * (n - 1) / 32.0::DOUBLE AS p FROM i)
SELECT x, y, z, round(l[CAST(floor(p) AS BIGINT) + 1] + (l[CAST(ceil(p) AS BIGINT) + 1] - l[CAST(floor(p) AS BIGINT) + 1]) * (p - floor(p)), 6) AS v FROM p""")
def interpolate_axis(spark, sf_dir):
    return _rounded(N.interpolated(_voxels(spark, sf_dir), "x", 33))


@query("center_crop", f"WITH {VOX} SELECT x - 6 AS x, y - 4 AS y, z, v FROM vox WHERE x BETWEEN 6 AND 12 AND y BETWEEN 4 AND 14")
def center_crop(spark, sf_dir):
    voxels = _voxels(spark, sf_dir)
    shape = extent(voxels)
    return N.center_crop(voxels, shape, (7, 11, shape[2]))


@query("pad_symmetrically", f"""WITH {VOX}, g AS (SELECT x, y, z FROM (SELECT unnest(range(0, 25)) AS x), (SELECT unnest(range(0, 23)) AS y), (SELECT unnest(range(0, (SELECT max(z) + 2 FROM vox))) AS z))
SELECT g.x, g.y, g.z, coalesce(vox.v, 0.0::DOUBLE) AS v FROM g LEFT JOIN vox ON g.x = vox.x + 2 AND g.y = vox.y + 1 AND g.z = vox.z""")
def pad_symmetrically(spark, sf_dir):
    voxels = _voxels(spark, sf_dir)
    shape = extent(voxels)
    return N.pad_symmetrically(voxels, shape, (25, 23, shape[2] + 1))


@query("box_total", f"WITH {VOX} SELECT round(sum(v), 4) AS v FROM vox WHERE x BETWEEN 3 AND 11 AND y BETWEEN 0 AND 8 AND z BETWEEN 2 AND 19")
def box_total(spark, sf_dir):
    return N.box_total(_voxels(spark, sf_dir), (3, 0, 2), (12, 9, 20)).select(F.round("v", 4).alias("v"))


@query("label_chunks", f"""WITH RECURSIVE {VOX}, e AS (SELECT a.id AS a, b.id AS b FROM vox a JOIN vox b ON a.label = b.label AND a.label <> 0 AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1
  AND a.x // 5 = b.x // 5 AND a.y // 5 = b.y // 5 AND a.z // 5 = b.z // 5 AND a.z BETWEEN b.z - 1 AND b.z + 1 AND a.y BETWEEN b.y - 1 AND b.y + 1),
r AS (SELECT id, id AS c FROM vox WHERE label <> 0 UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a) SELECT id, min(c) AS component FROM r GROUP BY id""")
def label_chunks(spark, sf_dir):
    return S.split_components(vox(spark, sf_dir), chunk=(5, 5, 5))
