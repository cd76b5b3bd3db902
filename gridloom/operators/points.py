"""Point clouds and embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.alignment import blocks_of
from gridloom.sources.shared import materialized

XYZ = ("x", "y", "z")
#: Points of one side that meet under one key when all pairs are asked for, about so many.
PART = 1024


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0))


def pair_distances(df: DataFrame, cloud: str = "cloud", queries: Column | None = None) -> DataFrame:
    """cloud, i, j, d2 of all pairs within a cloud; with ``queries`` only points i that it holds for, against all.

    Both sides of a cloud are dealt into parts of about ``PART`` points by
    hashes of their indices, and each part meets each other as a key of its
    own, so no task holds a cloud however large it is.
    """
    asking = df if queries is None else df.where(queries)
    parts = df.groupBy(cloud).agg(F.ceil(F.count("*") / PART).cast("int").alias("_n"))
    own, every = F.pmod(F.xxhash64("idx"), F.col("_n")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = asking.join(parts, cloud).withColumn("_ka", own).withColumn("_kb", every).select(cloud, "_ka", "_kb", F.col("idx").alias("i"), *[F.col(c).alias(f"a{c}") for c in XYZ])
    b = df.join(parts, cloud).withColumn("_kb", own).withColumn("_ka", every).select(cloud, "_ka", "_kb", F.col("idx").alias("j"), *[F.col(c).alias(f"b{c}") for c in XYZ])
    d2 = squared_distance([F.col(f"a{c}") for c in XYZ], [F.col(f"b{c}") for c in XYZ])
    return a.join(b.hint("merge"), [cloud, "_ka", "_kb"]).select(cloud, "i", "j", d2.alias("d2"))


def _cells(size: Column, suffix: str = "") -> list[Column]:
    return [F.floor(F.col(f"{c}{suffix}") / size).cast("bigint").alias(f"c{c}") for c in XYZ]


def _spread_cells(df: DataFrame) -> DataFrame:
    """Every row in its cell (cx, cy, cz) and the 26 around it."""
    for c in XYZ:
        df = df.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + d for d in (-1, 0, 1)])))
    return df


def knn(df: DataFrame, k: int, cloud: str = "cloud", queries: Column | None = None, within: float | None = None) -> DataFrame:
    """The k nearest points of each (itself among them), ties by index: cloud, i, rank, j, d2.

    With ``queries`` only points that it holds for ask, among all points; with
    ``within`` only points at that distance or nearer are found, maybe fewer than k.

    Points at one place count as one place with its k least indices, so copies
    make no pairs. Places look for others in their cell and those around it;
    those whose k-th neighbour is nearer than a cell is wide are settled, the
    others look again in cells twice as wide. Cells begin at a size that
    holds a few times k places on average, seen from one of them, so dense regions
    do not fill them; the rounds grow with the logarithm of the number
    of points, and only sparse places take part in late ones. Only pairs nearer
    than a cell is wide are kept. Points with a
    null or NaN coordinate or a null cloud are left out.
    """
    usable = F.lit(True)
    for c in XYZ:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    asks = (F.lit(True) if queries is None else queries).alias("_q")
    points = df.where(usable & F.col(cloud).isNotNull()).select(F.col(cloud).alias("_c"), "idx", asks, *[(F.col(c).cast("double") + 0.0).alias(c) for c in XYZ])
    place = ["_c", *XYZ]
    first = points.withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy("idx"))).where(F.col("_r") <= k)
    places = materialized(first.groupBy(*place).agg(F.array_sort(F.collect_list("idx")).alias("ids")), "places")
    wide = F.greatest(*[F.max(c) - F.min(c) for c in XYZ])
    clouds = places.groupBy("_c").agg(wide.alias("_w"), F.count("*").alias("_n"))
    size = F.when(F.col("_w") > 0, F.col("_w") / F.greatest(F.cbrt(F.col("_n") / (4 * k)), F.lit(1.0)) * 1.0001).otherwise(1.0)
    clouds = materialized(clouds.select("_c", size.alias("_size"), "_w"), "clouds")
    for _ in range(20):
        cells = places.join(clouds, "_c").groupBy("_c", "_size", "_w", *_cells(F.col("_size"))).agg(F.count("*").alias("_n"))
        # the mean number of places that a place finds in its own cell
        full = cells.groupBy("_c", "_size", "_w").agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("_m"))
        crowded = (F.col("_m") > 4 * k) & (F.col("_w") > 0)
        clouds = materialized(full.select("_c", F.when(crowded, F.col("_size") / 2).otherwise(F.col("_size")).alias("_size"), "_w", crowded.alias("_more")), "clouds")
        if clouds.where("_more").isEmpty():
            break
    clouds = clouds.select("_c", "_size", "_w")
    asking = points if queries is None else points.where("_q")
    waiting = places.select(*place) if queries is None else materialized(asking.select(*place).distinct(), "asking")
    found, factor = None, 1.0
    while not waiting.isEmpty():
        sized = places.join(clouds, "_c")
        s = F.col("_size") * factor
        near = sized.select("_c", F.col("ids"), *[F.col(c).alias(f"b{c}") for c in XYZ], *_cells(s))
        spread = _spread_cells(waiting.join(clouds, "_c").select(*place, s.alias("_s"), (F.col("_w") < s).alias("_all"), *_cells(s)))
        met = spread.join(near, ["_c", "cx", "cy", "cz"]).withColumn("d2", squared_distance([F.col(c) for c in XYZ], [F.col(f"b{c}") for c in XYZ]))
        met = met.where("_all OR d2 <= _s * _s")
        met = met if within is None else met.where(F.col("d2") <= within * within)
        w = Window.partitionBy(*place)
        best = met.withColumn("_r", F.row_number().over(w.orderBy("d2", F.get("ids", F.lit(0))))).where(F.col("_r") <= k)
        each = best.select(*place, "_s", "_all", "d2", F.explode("ids").alias("j")).withColumn("rank", F.row_number().over(w.orderBy("d2", "j"))).where(F.col("rank") <= k)
        lists = each.groupBy(*place, "_s", "_all").agg(F.sort_array(F.collect_list(F.struct("rank", "j", "d2"))).alias("near"))
        done = F.col("_all") | ((F.size("near") == k) & (F.get("near", F.lit(k - 1))["d2"] < F.col("_s") * F.col("_s")))
        done = done if within is None else done | (F.col("_s") > within * 1.0001)
        lists = materialized(lists.select(*place, "near", done.alias("done")), "near")
        settled = lists.where("done").select(*place, "near")
        found = settled if found is None else found.unionByName(settled)
        waiting, factor = lists.where("NOT done").select(*place), factor * 2
    if found is None:
        found = places.select(*place, F.expr("cast(null as array<struct<rank:int,j:bigint,d2:double>>)").alias("near"))
    out = asking.join(found, place).select(F.col("_c").alias(cloud), F.col("idx").alias("i"), F.explode("near").alias("_n"))
    return out.select(cloud, "i", F.col("_n.rank").cast("int").alias("rank"), F.col("_n.j").alias("j"), F.col("_n.d2").alias("d2"))


def ball_query(df: DataFrame, radius: float, most: int, cloud: str = "cloud", queries: Column | None = None) -> DataFrame:
    """Up to ``most`` nearest points within ``radius``, by :func:`knn`: in dense regions points meet in cells much smaller than that. With ``queries`` only points that it holds for ask."""
    finite = F.lit(True)
    for c in XYZ:
        finite = finite & (F.abs(F.col(c)) < float("inf"))
    return knn(df.where(finite), most, cloud, queries, float(radius))


def reorder(df: DataFrame, by: Column, cloud: str = "cloud", descending: bool = False) -> DataFrame:
    """Adds ``rank`` within the cloud by an expression, ties by index."""
    w = Window.partitionBy(cloud).orderBy(by.desc() if descending else by, "idx")
    return df.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def from_centroid(cloud: str = "cloud") -> Column:
    w = Window.partitionBy(cloud)
    return squared_distance([F.col(c) for c in XYZ], [F.avg(c).over(w) for c in XYZ])


def median_split_order(df: DataFrame, depth: int, cloud: str = "cloud") -> DataFrame:
    """Recursive halving by x, y, z in turn: a space-filling order of each cloud, as ``rank``."""
    out, keys = df, [cloud]
    for level in range(depth):
        w = Window.partitionBy(*keys).orderBy(XYZ[level % 3], "idx")
        whole = Window.partitionBy(*keys)
        out = out.withColumn(f"_h{level}", ((F.row_number().over(w) - 1) >= F.floor((F.count("*").over(whole) + 1) / 2)).cast("int"))
        keys.append(f"_h{level}")
    order = Window.partitionBy(cloud).orderBy(*keys[1:], XYZ[depth % 3], "idx")
    return out.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).drop(*keys[1:])


def with_reverse(df: DataFrame, cloud: str = "cloud") -> DataFrame:
    """Adds ``place``, each point's place by index in its cloud: the point at ``place`` goes to ``rank``, and the one at ``rank`` came from ``place``."""
    w = Window.partitionBy(cloud).orderBy("idx")
    return df.withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def orientation(df: DataFrame, cloud: str = "cloud") -> DataFrame:
    """cloud, axes, spread, rotation: directions of falling variance (rows), their variances (sample), and the rotation that turns the first to z and the second to y.

    The covariance is one aggregation; only six numbers a cloud go to Python.
    The largest component of each of the first two axes is positive, the third
    makes a right-handed system. Clouds of one point have no row.
    """
    names = [f"{a}{b}" for i, a in enumerate(XYZ) for b in XYZ[: i + 1]]
    covariance = df.groupBy(cloud).agg(F.count("*").alias("_n"), *[F.covar_samp(n[0], n[1]).alias(n) for n in names]).where("_n > 1").drop("_n")
    kind = df.schema[cloud].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.zeros((batch.num_rows, 3, 3))
            for n in names:
                i, j = XYZ.index(n[0]), XYZ.index(n[1])
                m[:, i, j] = m[:, j, i] = batch.column(n).to_numpy(zero_copy_only=False)
            values, vectors = np.linalg.eigh(m)
            axes = vectors.transpose(0, 2, 1)[:, ::-1]
            lead = np.take_along_axis(axes, np.abs(axes).argmax(axis=2)[..., None], 2)
            axes = axes * np.where(lead < 0, -1, 1)
            axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
            turn = np.stack([np.cross(axes[:, 1], axes[:, 0]), axes[:, 1], axes[:, 0]], axis=1)
            yield pa.RecordBatch.from_pydict({cloud: batch.column(cloud), "axes": pa.array(axes.tolist()), "spread": pa.array(values[:, ::-1].tolist()), "rotation": pa.array(turn.tolist())}, schema=pa.schema([(cloud, batch.column(cloud).type), *((c, t) for c, t in types.items())]))

    types = {"axes": pa.list_(pa.list_(pa.float64())), "spread": pa.list_(pa.float64()), "rotation": pa.list_(pa.list_(pa.float64()))}
    return covariance.mapInArrow(run, f"{cloud} {kind}, axes array<array<double>>, spread array<double>, rotation array<array<double>>")


def moments(df: DataFrame, n: int = 4, cloud: str = "cloud") -> DataFrame:
    """Means, covariances (population) and standardised moments 3..n of each axis of a cloud: one aggregation over centred points."""
    w = Window.partitionBy(cloud)
    centred = df.select(cloud, *XYZ, *[(F.col(c) - F.avg(c).over(w)).alias(f"d{c}") for c in XYZ])
    aggs = [F.avg(c).alias(f"mean_{c}") for c in XYZ]
    aggs += [F.avg(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"cov_{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[: i + 1]]
    aggs += [(F.avg(F.pow(f"d{c}", F.lit(k))) / F.pow(F.avg(F.col(f"d{c}") * F.col(f"d{c}")), F.lit(k / 2))).alias(f"m{k}_{c}") for k in range(3, n + 1) for c in XYZ]
    return centred.groupBy(cloud).agg(*aggs)


def _by_cloud(df: DataFrame, fn, schema: str, cloud: str) -> DataFrame:
    return df.groupBy(cloud).applyInPandas(fn, schema)


def farthest_points(df: DataFrame, n: int, cloud: str = "cloud") -> DataFrame:
    """Farthest point sampling from the first index: cloud, rank, idx. Sequential by nature, a cloud a task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        x, ids = p[list(XYZ)].to_numpy(), p["idx"].to_numpy()
        picked, least = [0], ((x - x[0]) ** 2).sum(1)
        while len(picked) < min(n, len(x)):
            picked.append(int(least.argmax()))
            least = np.minimum(least, ((x - x[picked[-1]]) ** 2).sum(1))
        return pd.DataFrame({cloud: p[cloud].iloc[0], "rank": range(len(picked)), "idx": ids[picked]})

    return _by_cloud(df, run, f"{cloud} int, rank int, idx bigint", cloud)


def spanning_tree(df: DataFrame, cloud: str = "cloud") -> DataFrame:
    """Euclidean minimum spanning tree of each cloud (Prim): cloud, i, j, d."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        x, ids = p[list(XYZ)].to_numpy(), p["idx"].to_numpy()
        best, source, out = ((x - x[0]) ** 2).sum(1), np.zeros(len(x), dtype=int), []
        inside = np.zeros(len(x), dtype=bool)
        inside[0] = True
        for _ in range(len(x) - 1):
            k = int(np.where(inside, np.inf, best).argmin())
            out.append((p[cloud].iloc[0], ids[source[k]], ids[k], float(best[k] ** 0.5)))
            inside[k] = True
            d = ((x - x[k]) ** 2).sum(1)
            closer = d < best
            best, source = np.where(closer, d, best), np.where(closer, k, source)
        return pd.DataFrame(out, columns=[cloud, "i", "j", "d"])

    return _by_cloud(df, run, f"{cloud} int, i bigint, j bigint, d double", cloud)


def principal_axes(df: DataFrame, cloud: str = "cloud") -> DataFrame:
    """Points turned so that x varies most, each axis with positive skew: a cloud a task, from its covariance."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p[list(XYZ)].to_numpy()
        x = x - x.mean(0)
        _, v = np.linalg.eigh(x.T @ x)
        y = x @ v[:, ::-1]
        y = y * np.where((y**3).sum(0) < 0, -1, 1)
        return pd.DataFrame({cloud: p[cloud], "idx": p["idx"]} | {c: y[:, k] for k, c in enumerate(XYZ)})

    return _by_cloud(df, run, f"{cloud} int, idx bigint, x double, y double, z double", cloud)


def lowpass(df: DataFrame, key: str, cutoff: float, t: str = "t", value: str = "v") -> DataFrame:
    """Second-order Butterworth filter, forward and backward, of each series (cutoff as a share of Nyquist)."""
    import math

    k = math.tan(math.pi * cutoff / 2)
    norm = 1 / (1 + math.sqrt(2) * k + k * k)
    b, a = (k * k * norm, 2 * k * k * norm, k * k * norm), (2 * (k * k - 1) * norm, (1 - math.sqrt(2) * k + k * k) * norm)

    def once(x: np.ndarray) -> np.ndarray:
        y, x1, x2, y1, y2 = np.empty(len(x)), x[0], x[0], x[0], x[0]
        for i, v in enumerate(x):
            w = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
            x1, x2, y1, y2, y[i] = v, x1, w, y1, w
        return y

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(t)
        x = p[value].to_numpy(dtype=float)
        return pd.DataFrame({key: p[key], t: p[t], value: once(once(x)[::-1])[::-1]})

    return df.select(key, t, value).groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {t} bigint, {value} double")


def pool(df: DataFrame, key: str, vector: str, how: str, p: float = 2.0) -> DataFrame:
    """Max, mean or p-norm mean of vectors by key: key, dim, v."""
    long = df.select(key, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    fn = {"max": F.max("v"), "mean": F.avg("v"), "lp": F.pow(F.avg(F.pow(F.abs("v"), F.lit(p))), F.lit(1 / p))}[how]
    return long.groupBy(key, "dim").agg(fn.alias("v"))


def normalized(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / norm)


#: Queries, and rows, whose likeness a task holds at once.
MATCH_QUERIES, MATCH_ROWS = 1_000, 1_000


def top_matches(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k most alike vectors (cosine) of ``base`` for each query (id, vector): id, rank, other, cosine.

    For a stated set of queries: they go to every task of ``base`` in counted
    blocks, and each task keeps its best k of a query before the exchange. What
    it holds at once are these and one small matrix of likeness.
    """
    found = None
    for block in blocks_of(queries.select("id", "vector"), "id"):
        rows = block.toArrow()
        ids, m = rows.column("id").to_numpy(), np.array(rows.column("vector").to_pylist(), dtype=float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)

        def best(batches: Iterator[pd.DataFrame], ids=ids, m=m) -> Iterator[pd.DataFrame]:
            tops: list[tuple[np.ndarray, np.ndarray]] = [(np.empty((0, 0)), np.empty((0, 0)))] * -(-len(ids) // MATCH_QUERIES)
            for b in batches:
                for first in range(0, len(b), MATCH_ROWS):
                    part = b.iloc[first : first + MATCH_ROWS]
                    x = np.array(part["vector"].tolist(), dtype=float)
                    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                    for n in range(len(tops)):
                        s = m[n * MATCH_QUERIES : (n + 1) * MATCH_QUERIES] @ x
                        own = np.broadcast_to(part["id"].to_numpy(), s.shape)
                        if tops[n][0].size:
                            s, own = np.hstack([tops[n][0], s]), np.hstack([tops[n][1], own])
                        order = np.lexsort((own, -s))[:, :k]
                        tops[n] = np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)
            for n, (s, own) in enumerate(tops):
                if s.size:
                    yield pd.DataFrame({"id": np.repeat(ids[n * MATCH_QUERIES : (n + 1) * MATCH_QUERIES], s.shape[1]), "other": own.ravel(), "cosine": s.ravel()})

        part = base.select("id", "vector").mapInPandas(best, "id bigint, other bigint, cosine double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.limit(0).select("id", F.lit(0).alias("rank"), F.col("id").alias("other"), F.lit(0.0).alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", F.col("rank").cast("int").alias("rank"), "other", "cosine")
