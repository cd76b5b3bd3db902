"""Segment graphs from point sets: closest pairs by cells, forests by rounds of least edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.points import XYZ, knn, squared_distance
from gridloom.operators.segmentation import connected
from gridloom.sources.shared import materialized


#: Places in a cell, seen from one of them, with which :func:`closest_pairs` begins.
FEW = 4


def _cells_around(df: DataFrame) -> DataFrame:
    for c in XYZ:
        df = df.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + d for d in (-1, 0, 1)])))
    return df


def closest_pairs(points: DataFrame, radius: float, group: str = "segment") -> DataFrame:
    """The closest two points (segment, idx, x, y, z) of any two segments within ``radius``: a < b, d2, ia, ib.

    Points of a segment at one place are one. Points meet in cells, at first so
    small that a cell holds a few places on average; two segments with points
    nearer than a cell is wide are settled there, and the others meet again in
    cells of twice the size, up to the radius. Settled segments meet no more,
    so dense regions make no pairs in wide cells. Of equal distances the least
    indices are taken.
    """
    r = float(radius)
    usable = points.dropna(subset=[group, *XYZ])
    places = materialized(usable.groupBy(F.col(group).alias("segment"), *[F.col(c).cast("double").alias(c) for c in XYZ]).agg(F.min("idx").alias("idx")), "places")
    size, spots = r, places.select(*XYZ).distinct()
    for _ in range(20):
        cells = spots.groupBy(*[F.floor(F.col(c) / size) for c in XYZ]).agg(F.count("*").alias("n"))
        # the mean number of places that a place finds in its own cell
        full = cells.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).first()[0]
        if full is None or full <= FEW:
            break
        size /= 2
    found = None
    while True:
        size = min(size, r)
        at = [F.floor(F.col(c) / size).alias(f"c{c}") for c in XYZ]
        left = places.select(F.col("segment").alias("a"), F.col("idx").alias("ia"), *[F.col(c).alias(f"a{c}") for c in XYZ], *at)
        right = places.select(F.col("segment").alias("b"), F.col("idx").alias("ib"), *[F.col(c).alias(f"b{c}") for c in XYZ], *at)
        left = _cells_around(left)
        near = left.join(right, ["cx", "cy", "cz"]).where("a < b")
        if found is not None:  # segments that share a cell's surroundings and are not settled, first by the cells that they lie in
            lone = left.select("a", "cx", "cy", "cz").distinct().join(right.select("b", "cx", "cy", "cz").distinct(), ["cx", "cy", "cz"]).where("a < b")
            lone = materialized(lone.join(found.select("a", "b"), ["a", "b"], "left_anti"), "open")
            if lone.isEmpty():
                if size >= r:
                    return found
                size *= 2
                continue
            near = left.join(lone, ["a", "cx", "cy", "cz"]).join(right, ["b", "cx", "cy", "cz"])
        d2 = squared_distance([F.col(f"a{c}") for c in XYZ], [F.col(f"b{c}") for c in XYZ])
        met = near.select("a", "b", "ia", "ib", d2.alias("d2")).where(F.col("d2") <= size * size)
        best = materialized(met.groupBy("a", "b").agg(F.min(F.struct("d2", "ia", "ib")).alias("m")).select("a", "b", "m.d2", "m.ia", "m.ib"), "closest")
        found = best if found is None else found.unionByName(best)
        if size >= r:
            return found
        size *= 2


def shortest_forest(pairs: DataFrame) -> DataFrame:
    """The edges of a minimum spanning forest of weighted pairs (a, b, d2, ia, ib).

    Each round, every part takes its least edge to another part (ties by
    indices, then ids, so no two edges are equal and no circle arises), and the
    parts so linked become one: the number of parts halves at least.
    """
    pairs = materialized(pairs, "pairs")
    chosen = None
    left = pairs.withColumns({"pa": F.col("a"), "pb": F.col("b")})
    while not left.isEmpty():
        edge = F.struct("d2", "ia", "ib", "a", "b")
        ends = left.select(F.col("pa").alias("part"), edge.alias("e")).unionByName(left.select(F.col("pb").alias("part"), edge.alias("e")))
        least = ends.groupBy("part").agg(F.min("e").alias("e")).select("e.*").distinct()
        chosen = materialized(least if chosen is None else chosen.unionByName(least).distinct(), "forest")
        parts = connected(chosen.select("a", "b"))
        left = pairs.join(parts.select(F.col("node").alias("a"), F.col("component").alias("_pa")), "a", "left").join(parts.select(F.col("node").alias("b"), F.col("component").alias("_pb")), "b", "left")
        left = left.select("a", "b", "d2", "ia", "ib", F.coalesce("_pa", "a").alias("pa"), F.coalesce("_pb", "b").alias("pb")).where("pa <> pb")
        left = materialized(left, "left")
    out = pairs.limit(0) if chosen is None else chosen
    return out.select("a", "b", "d2", "ia", "ib")


def _bounds(df: DataFrame, size: float, *keys: str) -> DataFrame:
    """Nodes: the box and number of places of each part in each cell (kx, ky, kz) of ``size``."""
    cells = [F.floor(F.col(c) / size).cast("bigint").alias(f"k{c}") for c in XYZ]
    box = [f(c).alias(f"{c}{e}") for c in XYZ for f, e in ((F.min, 0), (F.max, 1))]
    return df.select("part", *XYZ, *cells).groupBy("part", "kx", "ky", "kz").agg(*box, F.count("*").alias("n"))


def _gap(far: bool):
    """Squared least or greatest distance of the boxes of two nodes, whose columns begin with a and b."""
    total = F.lit(0.0)
    for c in XYZ:
        al, ah, bl, bh = (F.col(f"{side}{c}{e}") for side in "ab" for e in (0, 1))
        d = F.greatest(ah - bl, bh - al) if far else F.greatest(al - bh, bl - ah, F.lit(0.0))
        total = total + d * d
    return total


def _side(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select([F.col(c).alias(f"{side}{c}") for c in nodes.columns])


def _pruned(pairs: DataFrame) -> DataFrame:
    """Pairs of nodes that may hold the closest places of part ``apart`` and any other, with ``least``: its distance at most."""
    pairs = pairs.withColumns({"low": _gap(False), "high": _gap(True)})
    least = pairs.groupBy("apart").agg(F.min("high").alias("least")).withColumnRenamed("apart", "_p")
    return pairs.join(least, F.col("apart") == F.col("_p")).where(F.col("low") <= F.col("least")).drop("_p", "high")


def closest_other(placed: DataFrame, size: float, extent: float) -> DataFrame:
    """part, e: for each part of ``placed`` (part, segment, idx, x, y, z) its least edge to another part.

    An edge is (d2, a, b, ia, ib) with segments a < b. Parts are seen as the
    boxes of their points in cells: boxes of a quarter of ``size`` meet in
    cells of ``size`` around each other. A part that surely has another within
    ``size`` is settled there, others go on with twice the size. Of the
    settled, pairs of boxes nearer than the best one's farthest corners are
    divided into smaller boxes until few points are left in them, and only
    those meet. Points of one segment at one place are one.
    """
    places = materialized(placed.groupBy("part", "segment", *XYZ).agg(F.min("idx").alias("idx")), "places")
    waiting, out = places.select("part").distinct(), None
    while True:
        nodes = materialized(_bounds(places, size / 4), "nodes")
        cells = [F.floor(F.col(f"k{c}") / 4).alias(f"c{c}") for c in XYZ]
        mine = nodes.join(waiting, "part", "left_semi").select("*", *cells)
        left = mine
        for c in XYZ:
            left = left.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + d for d in (-1, 0, 1)])))
        here = left.select([F.col(c).alias(c if c in ("cx", "cy", "cz") else f"a{c}") for c in left.columns])
        there = nodes.select(*[F.col(c).alias(f"b{c}") for c in nodes.columns], *cells)
        pairs = _pruned(here.join(there, ["cx", "cy", "cz"]).where("apart <> bpart").drop("cx", "cy", "cz"))
        last = size > 2 * extent
        pairs = materialized(pairs if last else pairs.where(F.col("least") <= size * size), "pairs")
        found = materialized(pairs.select(F.col("apart").alias("part")).distinct(), "found")
        if not found.isEmpty():
            edges = materialized(_closest_points(pairs, places, size / 4), "edges")
            out = edges if out is None else out.unionByName(edges)
        waiting = materialized(waiting.join(found, "part", "left_anti"), "waiting")
        if last or waiting.isEmpty():
            return out if out is not None else places.select("part", F.lit(None).cast("struct<d2:double,a:bigint,b:bigint,ia:bigint,ib:bigint>").alias("e")).limit(0)
        size *= 2


def _divided(pairs: DataFrame, places: DataFrame, size: float) -> DataFrame:
    """Pairs of the boxes of ``size`` within each pair of boxes of twice the size."""
    nodes = materialized(_bounds(places, size), "nodes")
    key = lambda side: [F.floor(F.col(f"{side}k{c}") / 2).cast("bigint").alias(f"{side}u{c}") for c in XYZ]
    on = lambda side: [f"{side}part", *(f"{side}u{c}" for c in XYZ)]
    above = pairs.select(*[F.col(f"{side}part") for side in "ab"], *[F.col(f"{side}k{c}").alias(f"{side}u{c}") for side in "ab" for c in XYZ])
    first, second = _side(nodes, "a").select("*", *key("a")), _side(nodes, "b").select("*", *key("b"))
    return above.join(first, on("a")).join(second, on("b"))


def _closest_points(pairs: DataFrame, places: DataFrame, size: float, few: int = 64) -> DataFrame:
    for _ in range(40):
        if pairs.where(F.col("an") * F.col("bn") > few).isEmpty():
            break
        size /= 2
        pairs = materialized(_pruned(_divided(pairs, places, size)), "pairs")
    cells = [F.floor(F.col(c) / size).cast("bigint").alias(f"k{c}") for c in XYZ]
    at = places.select("part", "segment", "idx", *XYZ, *cells)
    keys = lambda side: [f"{side}part", *(f"{side}k{c}" for c in XYZ)]
    both = pairs.select(*keys("a"), *keys("b")).join(_side(at, "a"), keys("a")).join(_side(at, "b"), keys("b"))
    d2 = squared_distance([F.col(f"a{c}") for c in XYZ], [F.col(f"b{c}") for c in XYZ])
    turned = F.col("asegment") > F.col("bsegment")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    edge = F.struct(d2.alias("d2"), pick("asegment", "bsegment").alias("a"), pick("bsegment", "asegment").alias("b"), pick("aidx", "bidx").alias("ia"), pick("bidx", "aidx").alias("ib"))
    return both.groupBy(F.col("apart").alias("part")).agg(F.min(edge).alias("e"))


def segment_graph(points: DataFrame, radius: float, group: str = "segment") -> DataFrame:
    """Links all segments of a point set into one tree by their proximity: a, b, d2, ia, ib.

    Segments within ``radius`` are linked first, by a minimum spanning forest.
    As long as several parts are left, each takes its least edge to another
    one (see :func:`closest_other`), so their number halves at least and the
    rounds end. The result is that of comparing all segments, of equal
    distances the least segments and indices. Points with a null or NaN
    coordinate or a null segment link nothing and are left out.
    """
    if radius <= 0:
        raise ValueError(f"a radius of {radius}")
    usable = F.col(group).isNotNull()
    for c in XYZ:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    points = materialized(points.where(usable).select(F.col(group).cast("bigint").alias("segment"), F.col("idx").cast("bigint").alias("idx"), *[F.col(c).cast("double").alias(c) for c in XYZ]), "points")
    low = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in XYZ]).first()
    extent = max((v or 0.0) for v in low)
    found = materialized(shortest_forest(closest_pairs(points, radius)), "links")
    segments = materialized(points.select(F.col("segment").alias("node")).distinct(), "segments")
    while True:
        parts = connected(found.select("a", "b"), segments)
        placed = points.join(parts.select(F.col("node").alias("segment"), F.col("component").alias("part")), "segment")
        if parts.select("component").distinct().limit(2).count() < 2:
            return found
        more = closest_other(placed, float(radius), extent).select("e.*").distinct()
        found = materialized(found.unionByName(more.select("a", "b", "d2", "ia", "ib")), "links")


def farthest(df: DataFrame, cloud: str = "cloud", few: int = 64) -> DataFrame:
    """cloud, i, d2: the squared distance of each point to the farthest one of its cloud.

    Boxes of points meet first, at most 125 a cloud. For each box those stay
    whose farthest corners are not nearer than the nearest corners of another;
    they are divided until few points are left in a pair, and these meet.
    """
    points = df.dropna(subset=[cloud, *XYZ]).select(F.col(cloud).alias("part"), "idx", *[F.col(c).cast("double").alias(c) for c in XYZ])
    places = materialized(points.select("part", *XYZ).distinct(), "places")
    wide = places.groupBy("part").agg(F.greatest(*[F.max(c) - F.min(c) for c in XYZ]).alias("w")).agg(F.max("w")).first()[0]
    size = (wide or 1.0) / 4
    own = ["apart", "akx", "aky", "akz"]

    def kept(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumns({"low": _gap(False), "high": _gap(True)})
        most = pairs.groupBy(*own).agg(F.max("low").alias("most"))
        return pairs.join(most, own).where(F.col("high") >= F.col("most")).drop("most", "low", "high")

    nodes = materialized(_bounds(places, size), "nodes")
    pairs = materialized(kept(_side(nodes, "a").join(_side(nodes, "b"), F.col("apart") == F.col("bpart"))), "pairs")
    for _ in range(40):
        if pairs.where(F.col("an") * F.col("bn") > few).isEmpty():
            break
        size /= 2
        pairs = materialized(kept(_divided(pairs, places, size)), "pairs")
    cells = [F.floor(F.col(c) / size).cast("bigint").alias(f"k{c}") for c in XYZ]
    at = places.select("*", *cells)
    keys = lambda side: [f"{side}part", *(f"{side}k{c}" for c in XYZ)]
    both = pairs.select(*keys("a"), *keys("b")).join(_side(at, "a"), keys("a")).join(_side(at, "b"), keys("b"))
    far = both.groupBy("apart", *[f"a{c}" for c in XYZ]).agg(F.max(squared_distance([F.col(f"a{c}") for c in XYZ], [F.col(f"b{c}") for c in XYZ])).alias("d2"))
    far = far.select(F.col("apart").alias("part"), *[F.col(f"a{c}").alias(c) for c in XYZ], "d2")
    return points.join(far, ["part", *XYZ]).select(F.col("part").alias(cloud), F.col("idx").alias("i"), "d2")


def neighbour_statistics(df: DataFrame, cloud: str = "cloud") -> DataFrame:
    """Distance of the centroid from the origin, and mean and deviation of nearest and farthest distances; clouds of one point have none."""
    near = knn(df, 2, cloud).where("rank = 2").select(cloud, "i", F.sqrt("d2").alias("near"))
    d = near.join(farthest(df, cloud).select(cloud, "i", F.sqrt("d2").alias("far")), [cloud, "i"])
    stats = d.groupBy(cloud).agg(F.avg("near").alias("near_mean"), F.stddev_pop("near").alias("near_std"), F.avg("far").alias("far_mean"), F.stddev_pop("far").alias("far_std"))
    origin = df.groupBy(cloud).agg(F.sqrt(F.avg("x") * F.avg("x") + F.avg("y") * F.avg("y") + F.avg("z") * F.avg("z")).alias("origin"))
    return origin.join(stats, cloud)
