"""Queries of distance transforms, growing, erosion, resampling and stored arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import contours as C
from gridloom.operators import distance as D
from gridloom.operators import points as P
from gridloom.operators import runs
from gridloom.operators import transport as T
from gridloom.operators import warp as W
from gridloom.plans.catalog import query
from gridloom.plans.views import CLOUD, VOX, cloud, extent, table, vox
from gridloom.sources import arrays
from gridloom.sources.shared import shared_path

#: Sparse seeds: users whose id divides by 40 leave their label, all else is empty.
_SPARSE = f"{VOX.replace('vox AS', 'raw AS')}, vox AS (SELECT x, y, z, CASE WHEN user_id % 40 = 0 THEN user_id + 1 ELSE 0 END AS label FROM raw)"


def _sparse(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", F.when(F.col("user_id") % 40 == 0, F.col("user_id") + 1).otherwise(0).cast("bigint").alias("label"))


def nearest_sql(before: str, seeds: str, voxel: dict[str, float], city: bool = False) -> str:
    """Nearest seeds in SQL, an axis at a time by comparing all voxels of a line."""
    out, last = f"n0 AS (SELECT x, y, z, label, CASE WHEN {seeds} THEN {{'d': CAST(0 AS DOUBLE), 'l': label}} END AS m FROM {before})", "n0"
    for k, (axis, w) in enumerate(voxel.items(), 1):
        others = ", ".join(a for a in "xyz" if a != axis)
        step = f"abs(a.{axis} - b.{axis}) * {w}" if city else f"(a.{axis} - b.{axis}) * (a.{axis} - b.{axis}) * {w * w}"
        out += f", n{k} AS (SELECT a.x, a.y, a.z, any_value(a.label) AS label, min(CASE WHEN b.m IS NOT NULL THEN {{'d': b.m.d + {step}, 'l': b.m.l}} END) AS m FROM {last} a JOIN {last} b USING ({others}) GROUP BY a.x, a.y, a.z)"
        last = f"n{k}"
    return f"{out}, near AS (SELECT x, y, z, label, m.d AS d, m.l AS near FROM {last})"


_VOXEL = {"x": 1, "y": 1, "z": 2}


@query("distance_map", f"WITH {_SPARSE}, {nearest_sql('vox', 'label <> 0', _VOXEL)} SELECT x, y, z, round(sqrt(d), 6) AS distance FROM near")
def distance_map(spark, sf_dir):
    return D.distance_map(_sparse(spark, sf_dir), _VOXEL).withColumn("distance", F.round("distance", 6))


@query("watershed_expand", f"WITH {_SPARSE}, {nearest_sql('vox', 'label <> 0', _VOXEL)} SELECT x, y, z, CASE WHEN sqrt(d) <= 2.5 AND x % 5 < 4 THEN near ELSE label END AS label FROM near")
def watershed_expand(spark, sf_dir):
    df = _sparse(spark, sf_dir)
    return D.expand_labels(df, _VOXEL, 2.5, F.col("x") % 5 < 4).select("x", "y", "z", "label")


_BLOCKS = f"{VOX.replace('vox AS', 'raw AS')}, vox AS (SELECT x, y, z, CASE WHEN user_id % 97 = 0 THEN 0 ELSE 1 + (x // 7) * 100000 + (y // 6) * 1000 + z // 5 END AS label FROM raw)"


def _blocks(spark, sf_dir):
    block = F.expr("1L + (x div 7) * 100000 + (y div 6) * 1000 + z div 5")
    return vox(spark, sf_dir).select("x", "y", "z", F.when(F.col("user_id") % 97 == 0, 0).otherwise(block).cast("bigint").alias("label"))


def _apart_sql() -> str:
    out, last = "", "vox"
    for k, axis in enumerate("xyz", 1):
        others = ", ".join(a for a in "xyz" if a != axis)
        now = "" if k == 1 else "was, "
        keep = "label AS was, " if k == 1 else now
        out += f", s{k} AS (SELECT x, y, z, {keep}CASE WHEN lag({axis}) OVER w = {axis} - 1 AND lag(label) OVER w <> label AND lag(label) OVER w <> 0 THEN 0 ELSE label END AS label FROM {last} WINDOW w AS (PARTITION BY {others} ORDER BY {axis}))"
        last = f"s{k}"
    return out


_UNIT = {"x": 1, "y": 1, "z": 1}


@query("erode_radius", f"""WITH {_BLOCKS}{_apart_sql()}, {nearest_sql('s3', 'label = 0', _UNIT)},
small AS (SELECT label FROM vox GROUP BY label HAVING count(*) <= 60)
SELECT x, y, z, CASE WHEN s3.was IN (SELECT label FROM small) THEN s3.was WHEN d > 1 OR d IS NULL THEN near.label ELSE 0 END AS label FROM near JOIN s3 USING (x, y, z)""")
def erode_radius(spark, sf_dir):
    return D.eroded(_blocks(spark, sf_dir), 1, 60)


@query("erode_objects", f"""WITH {_BLOCKS}, e AS (SELECT a.x, a.y, a.z, a.label, count(b.label) < 6 AS edge FROM vox a
  LEFT JOIN (SELECT x + dx AS x, y + dy AS y, z + dz AS z, label FROM vox, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) f(dx, dy, dz)) b
  ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.label = b.label GROUP BY ALL), {nearest_sql('e', 'edge', _UNIT, True)},
deep AS (SELECT *, d + 1 AS steps FROM near WHERE label <> 0), left_ AS (SELECT label, count(*) FILTER (WHERE steps > 1) AS one, count(*) FILTER (WHERE steps > 2) AS two FROM deep GROUP BY label)
SELECT n.x, n.y, n.z, CASE WHEN n.label = 0 THEN 0 WHEN n.d + 1 > CASE WHEN one < 20 THEN 0 WHEN two < 20 THEN 1 ELSE 2 END THEN n.label ELSE 0 END AS label FROM near n LEFT JOIN left_ l ON l.label = n.label""")
def erode_objects(spark, sf_dir):
    return D.eroded_objects(_blocks(spark, sf_dir), 2, 20)


#: All places of the volume's extent: a stored array, or a resampled one, has a value at each.
_ALL = "g AS (SELECT a.x, b.y, c.z FROM range(20) a(x), range(20) b(y), range((SELECT max(z) + 1 FROM vox)) c(z))"
#: Each plane turned by 30 degrees about (9, 9) and shifted, as a map from output to source.
_TURN = ((0.8660254037844387, 0.5, -2.25), (-0.5, 0.8660254037844387, 6.75))


@query("warp_linear", f"""WITH {VOX}, {_ALL}, p AS (SELECT x, y, z, {' + '.join(f'({m} * {a})' for m, a in zip(_TURN[0], ('x', 'y', '1'), strict=True))} AS u, {' + '.join(f'({m} * {a})' for m, a in zip(_TURN[1], ('x', 'y', '1'), strict=True))} AS w FROM g),
f AS (SELECT x, y, z, CAST(floor(round(u, 9)) AS BIGINT) AS i, CAST(floor(round(w, 9)) AS BIGINT) AS j, round(u, 9) - floor(round(u, 9)) AS s, round(w, 9) - floor(round(w, 9)) AS t FROM p),
c AS (SELECT f.*, i + dx AS sx, j + dy AS sy, (CASE dx WHEN 0 THEN 1 - s ELSE s END) * (CASE dy WHEN 0 THEN 1 - t ELSE t END) AS q FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dx, dy))
SELECT c.x, c.y, c.z, round(sum(q * coalesce(b.v, -1.0::DOUBLE)), 5) AS v FROM c LEFT JOIN vox b ON b.x = sx AND b.y = sy AND b.z = c.z GROUP BY ALL""")
def warp_linear(spark, sf_dir):
    voxels = vox(spark, sf_dir).select("x", "y", "z", "v")
    return W.warp(voxels, extent(voxels), _TURN, "linear", "constant", -1.0, inverted=True).withColumn("v", F.round("v", 5))


@query("stored_chain", f"WITH {VOX}, {_ALL} SELECT x // 2 AS x, y // 2 AS y, z, round(max(least(greatest(coalesce(v, 0), 10.0), 90.0)), 6) AS v FROM g LEFT JOIN vox USING (x, y, z) GROUP BY 1, 2, 3")
def stored_chain(spark, sf_dir):
    """The volume as a stored array, a chain over it to another one of which a part is there already, and that read again."""
    voxels = vox(spark, sf_dir).select("z", "y", "x", "v")
    nx, ny, nz = extent(voxels)
    root = shared_path(spark, "arrays")
    root = root if "://" in root else f"file://{root}"
    source = arrays.create_array(arrays.array_spec(f"{root}/in|zarr:", ("z", "y", "x"), (nz, ny, nx), (4, 8, 8), "f8"))
    arrays.write_array(voxels, source.path)
    chain, target = "clip(10.0, high=90.0) | down('max', x=2, y=2)", f"{root}/out|zarr:"
    runs.run_chain(spark, source.path, chain, target)
    spec = arrays.open_array(target)
    lost = spark.range(int(spec.grid[0] * spec.grid[1] * spec.grid[2])).where("id % 3 = 0").select(F.col("id").alias("chunk"))
    arrays.write_blocks(lost, target, lambda index: spec.empty(index))  # as if these had never been made
    runs.run_chain(spark, source.path, chain, target, nonzero=True)
    return arrays.read_array(spark, target).select("x", "y", "z", F.round("v", 6).alias("v"))


@query("stored_box_read", f"WITH {VOX}, {_ALL} SELECT x, y, z, coalesce(v, 0) AS v FROM g LEFT JOIN vox USING (x, y, z) WHERE x BETWEEN 3 AND 10 AND y >= 6 AND z < 9")
def stored_box_read(spark, sf_dir):
    """A stored array read through its data source, comparisons of coordinates pruning chunks."""
    voxels = vox(spark, sf_dir).select("z", "y", "x", "v")
    nx, ny, nz = extent(voxels)
    root = shared_path(spark, "arrays")
    root = root if "://" in root else f"file://{root}"
    spec = arrays.create_array(arrays.array_spec(f"{root}/n5|n5:", ("z", "y", "x"), (nz, ny, nx), (4, 8, 8), "f8", codec="gzip"))
    arrays.write_array(voxels, spec.path)
    return arrays.read_array(spark, spec.path).where("x BETWEEN 3 AND 10 AND y >= 6 AND z < 9").select("x", "y", "z", "v")


@query("contour_mask")
def contour_mask(spark, sf_dir):
    voxels = vox(spark, sf_dir).select("x", "y", "z", "v")
    return C.contour_mask(voxels, extent(voxels), (0, 0), 2, 1, 1)


@query("curve_order_and_back", f"WITH {CLOUD} SELECT cloud, idx, CAST(row_number() OVER (PARTITION BY cloud ORDER BY x, idx) - 1 AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY cloud ORDER BY idx) - 1 AS INTEGER) AS place FROM cloud")
def curve_order_and_back(spark, sf_dir):
    return P.with_reverse(P.reorder(cloud(spark, sf_dir), F.col("x"))).select("cloud", "idx", "rank", "place")


@query("orientation_spread", f"WITH {CLOUD} SELECT cloud, round(var_samp(x) + var_samp(y) + var_samp(z), 6) AS total, round(2 * (var_samp(x) * var_samp(y) + var_samp(y) * var_samp(z) + var_samp(x) * var_samp(z) - pow(covar_samp(x, y), 2) - pow(covar_samp(y, z), 2) - pow(covar_samp(x, z), 2)), 6) AS pairs FROM cloud GROUP BY cloud")
def orientation_spread(spark, sf_dir):
    """The sums of variances along the axes found, and of their products: what no rotation changes."""
    s = [F.get("spread", F.lit(k)) for k in range(3)]
    found = P.orientation(cloud(spark, sf_dir))
    return found.select("cloud", F.round(s[0] + s[1] + s[2], 6).alias("total"), F.round(2 * (s[0] * s[1] + s[1] * s[2] + s[0] * s[2]), 6).alias("pairs"))


@query("transport_order")
def transport_order(spark, sf_dir):
    """Two clouds of each label, from the first and the next three dimensions, in an order of belonging together."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda k: e.select(F.col("label").alias("cloud"), F.col("vec_id").alias("idx"), *[F.get("embedding", F.lit(k + i)).cast("double").alias(a) for i, a in enumerate("xyz")])
    return T.transport_order(part(0), part(3), 0.01, 4)
