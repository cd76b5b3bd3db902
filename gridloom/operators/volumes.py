"""Volume operators: projections along axes, resampling, splitting, masks, neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.filters import box

AXES = ("x", "y", "z")
#: Voxels along each axis of the blocks that windows are cut from, and voxels of windows that are cut at once.
WINDOW_BLOCK = 32
WINDOWS_AT_ONCE = 1 << 18


def finite(c: Column) -> Column:
    """NaN as null; infinities as 0."""
    return F.when(F.isnan(c), None).when(F.abs(c) == float("inf"), 0.0).otherwise(c)


def project(df: DataFrame, dim: str, how: str, value: str = "v", axes: Sequence[str] = AXES) -> DataFrame:
    """Reduces one axis by max, mean, std (population), sum or min, ignoring NaN."""
    c = finite(F.col(value))
    fn = {"max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_pop, "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0))}[how]
    return df.groupBy(*[a for a in axes if a != dim]).agg(fn(c).alias(value))


def zscore(df: DataFrame, dim: str | None, value: str = "v", axes: Sequence[str] = AXES) -> DataFrame:
    """(v - mean) / std (population) along one axis, or over the whole volume."""
    if dim is None:
        stats = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        both = df.crossJoin(F.broadcast(stats))  # one row
        return both.withColumn(value, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")
    w = Window.partitionBy(*[a for a in axes if a != dim])
    return df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w))


def downsample(df: DataFrame, factors: dict[str, int], how: str, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Reduces blocks: mean, min, max, median, mode (least of equals) or stride (the first voxel)."""
    if how == "stride":
        kept = reduce(lambda a, b: a & b, [F.col(a) % f == 0 for a, f in factors.items()])
        return df.where(kept).select(*keys, *[F.floor(F.col(a) / factors[a]).alias(a) if a in factors else F.col(a) for a in AXES], value)
    blocks = [F.floor(F.col(a) / factors.get(a, 1)).alias(a) for a in AXES]
    coarse = df.select(*keys, *blocks, value)
    if how == "mode":
        counts = coarse.groupBy(*keys, *AXES, value).agg(F.count("*").alias("_n"))
        return counts.groupBy(*keys, *AXES).agg(F.max(F.struct("_n", (-F.col(value)).alias("_neg"))).alias("_b")).select(*keys, *AXES, (-F.col("_b._neg")).alias(value))
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median}[how]
    return coarse.groupBy(*keys, *AXES).agg(fn(value).alias(value))


def downsample_area(df: DataFrame, start: Sequence[int], scale: Sequence[int], masked: Column | None = None, value: str = "v") -> DataFrame:
    """Area mean over blocks of the global grid, half to even; masked voxels do not count; a leading partial block goes."""
    off = [(s - o % s) % s for o, s in zip(start, scale, strict=True)]
    inside = reduce(lambda a, b: a & b, [F.col(a) >= o for a, o in zip(AXES, off, strict=True)])
    keys = [F.floor((F.col(a) - o) / s).alias(a) for a, o, s in zip(AXES, off, scale, strict=True)]
    c = F.col(value) if masked is None else F.when(~masked, F.col(value))
    return df.where(inside).select(*keys, c.alias(value)).groupBy(*AXES).agg(F.bround(F.avg(value)).alias(value))


def upsample(df: DataFrame, factors: dict[str, int]) -> DataFrame:
    """Nearest neighbour: every voxel becomes a block."""
    out = df
    for a, f in factors.items():
        out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(f - 1)))).withColumn(a, F.col(a) * f + F.col("_o")).drop("_o")
    return out


def pyramid(df: DataFrame, factors: Sequence[dict[str, int]], how: str = "mean", value: str = "v") -> DataFrame:
    """All levels of a multiscale volume, each from the full resolution; ``level`` 0 is the input."""
    levels = [df.select(F.lit(0).alias("level"), *AXES, value)]
    for k, f in enumerate(factors, 1):
        levels.append(downsample(df, f, how, value).select(F.lit(k).alias("level"), *AXES, value))
    return reduce(DataFrame.unionByName, levels)


def split(df: DataFrame, size: Sequence[int], origin: Sequence[int] = (0, 0, 0)) -> DataFrame:
    """Adds the chunk (cx, cy, cz) of a regular grid at ``origin`` and the place within it (rx, ry, rz)."""
    out = df
    for a, s, o in zip(AXES, size, origin, strict=True):
        out = out.withColumn(f"c{a}", F.floor((F.col(a) - o) / s)).withColumn(f"r{a}", F.pmod(F.col(a) - o, F.lit(s)))
    return out


def merge_where_empty(a: DataFrame, b: DataFrame, empty: float | None = 0.0, value: str = "v") -> DataFrame:
    """Values of ``a``; where empty (None: NaN), those of ``b`` if it has the voxel."""
    missing = F.isnan(value) if empty is None else F.col(value) == empty
    both = a.join(b.select(*AXES, F.col(value).alias("_b")), list(AXES), "left")
    return both.withColumn(value, F.when(missing & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col(value))).drop("_b")


def index_dim(df: DataFrame, dim: str, indices: Sequence[int]) -> DataFrame:
    """Picks indices of one axis, in their order; an index may come more than once."""
    picks = F.explode(F.transform(F.array(*map(F.lit, indices)), lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    if not indices:
        return df.limit(0)
    chosen = df.where(F.col(dim).isin(list(indices)))
    return chosen.withColumn("_p", picks).where(F.col("_p.v") == F.col(dim)).withColumn(dim, F.col("_p.i").cast("bigint")).drop("_p")


def min_sum(df: DataFrame, chunk: Sequence[str], least: float, value: str = "v") -> DataFrame:
    """Zeroes chunks whose sum is below ``least``."""
    sums = df.groupBy(*chunk).agg(F.sum(value).alias("_s"))
    return df.join(sums, list(chunk)).withColumn(value, F.when(F.col("_s") < least, F.lit(0.0)).otherwise(F.col(value))).drop("_s")


def boundary_mask(df: DataFrame, shape: Sequence[int], before: Sequence[int], after: Sequence[int]) -> DataFrame:
    """``mask``: false within the margins."""
    inside = reduce(lambda a, b: a & b, [(F.col(d) >= lo) & (F.col(d) < n - hi) for d, n, lo, hi in zip(AXES, shape, before, after, strict=True)])
    return df.withColumn("mask", inside)


def channel_mask(value: Column, low: float | None = None, high: float | None = None, values: Sequence[float] | None = None, invert: bool = False) -> Column:
    """Inclusive range or set membership."""
    if values is not None:
        out = value.isin(list(values))
    else:
        out = (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value <= high)
    return ~out if invert else out


def build_mask(configs: Sequence[tuple[Sequence[Column], bool]], invert: bool = False) -> Column:
    """OR over the channels of a configuration, its inversion, OR over configurations, and the last inversion."""
    parts = []
    for channels, flip in configs:
        one = reduce(lambda a, b: a | b, channels)
        parts.append(~one if flip else one)
    out = reduce(lambda a, b: a | b, parts)
    return ~out if invert else out


def dilate(df: DataFrame, radius: dict[str, int], mask: str = "mask") -> DataFrame:
    """True where any voxel of the box neighbourhood is: the field of view of a mask."""
    return box(df.select(*AXES, F.col(mask).cast("int").alias(mask)), radius, "max", mask).withColumn(mask, F.col(mask) > 0)


def integral_image(df: DataFrame, value: str = "v") -> DataFrame:
    """Sums over all voxels at or before each one, plane by plane (z): two running sums."""
    by_x = Window.partitionBy("z", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    by_y = Window.partitionBy("z", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_r", F.sum(value).over(by_x)).withColumn(value, F.sum("_r").over(by_y)).drop("_r")


def box_sums(integral: DataFrame, dx: int, dy: int, value: str = "v") -> DataFrame:
    """Sums of dx by dy windows that lie within the plane, at their first corner, from an integral image."""
    s = integral.select(*AXES, value)
    corner = lambda ox, oy, name: s.select((F.col("x") + ox).alias("x"), (F.col("y") + oy).alias("y"), "z", F.col(value).alias(name))
    out = corner(1 - dx, 1 - dy, "_d").where("x >= 0 AND y >= 0")
    for ox, oy, name in ((1, 1 - dy, "_b"), (1 - dx, 1, "_c"), (1, 1, "_a")):
        out = out.join(corner(ox, oy, name), list(AXES), "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    return out.select(*AXES, (F.col("_d") - zero("_b") - zero("_c") + zero("_a")).alias(value))


def laplacian(df: DataFrame, value: str = "v") -> DataFrame:
    """Four-neighbour Laplacian in the plane; a missing neighbour repeats the voxel."""
    out = df
    for a, others in (("x", ("y", "z")), ("y", ("x", "z"))):
        w = Window.partitionBy(*others).orderBy(a)
        out = out.withColumn(f"_{a}", F.coalesce(F.lag(value).over(w), F.col(value)) + F.coalesce(F.lead(value).over(w), F.col(value)) - 2 * F.col(value))
    return out.withColumn(value, F.col("_x") + F.col("_y")).drop("_x", "_y")


def objects_context(vox: DataFrame, centres: DataFrame, width: Sequence[int], value: str = "v") -> DataFrame:
    """The window of ``width`` around each object's centre (object, x, y, z): object, dx, dy, dz, value; 0 where the volume has no voxel.

    Voxels are sent to the block that holds them and to those whose centres
    see them, centres to their own; windows are cut out there, as one array a
    centre, and become rows without a further exchange. Centres are streamed,
    so a task holds one block of voxels. Of several voxels at one place each
    gives a row.
    """
    blocks = [max(WINDOW_BLOCK, n) for n in width]
    low, high = [-(n // 2) for n in width], [n - n // 2 - 1 for n in width]
    at = [F.col(a).cast("bigint").alias(a) for a in AXES]
    kind, number = centres.schema["object"].dataType.simpleString(), F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    given = vox.dropna(subset=list(AXES)).select(*at, number.alias("v"))
    sent = given
    for a, n, lo, hi in zip(AXES, blocks, low, high, strict=True):
        sent = sent.withColumn(f"b{a}", F.explode(F.array_distinct(F.array(F.floor((F.col(a) - hi) / n), F.floor(F.col(a) / n), F.floor((F.col(a) - lo) / n)))))
    keys = [f"b{a}" for a in AXES]
    voxels = sent.select(*keys, F.lit(0).alias("side"), *AXES, "v", F.lit(None).cast(kind).alias("object"))
    own = [F.coalesce(F.floor(F.col(a) / n), F.lit(0).cast("bigint")).alias(f"b{a}") for a, n in zip(AXES, blocks, strict=True)]
    asking = centres.select(*own, F.lit(1).alias("side"), *at, F.lit(None).cast("double").alias("v"), "object")
    rows = voxels.unionByName(asking).repartition(int(vox.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "side")
    steps = np.stack(np.meshgrid(*[np.arange(lo, hi + 1) for lo, hi in zip(low, high, strict=True)], indexing="ij"), -1).reshape(-1, 3)
    few = max(1, WINDOWS_AT_ONCE // len(steps))
    span = [n + hi - lo for n, lo, hi in zip(blocks, low, high, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None

        def indexed() -> tuple[np.ndarray, np.ndarray]:
            """Places within the block and what its centres see, in order, and their values."""
            place, v = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0))
            order = np.argsort(place, kind="stable")
            return place[order], v[order]

        def windows(objects: pa.Array, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            place, v = index
            seen = numbered(p[:, None, :] + steps)
            first = np.searchsorted(place, seen)
            most = np.searchsorted(place, seen, "right") - first
            for k in range(max(1, int(most.max(initial=0)))):
                there = most > k
                cut = np.zeros(seen.shape)
                cut[there] = v[first[there] + k]
                # a further voxel at a place gives a row where there is one; the first always does
                missing = None if k == 0 else ~there.ravel()
                flat = pa.array(cut.ravel(), mask=missing)
                yield pa.RecordBatch.from_pydict({"object": objects, "v": pa.ListArray.from_arrays(pa.array(np.arange(0, cut.size + 1, len(steps)), pa.int32()), flat)})

        def numbered(p: np.ndarray) -> np.ndarray:
            out = np.zeros(p.shape[:-1], np.int64)
            for k in range(3):
                out = out * span[k] + (p[..., k] - block[k] * blocks[k] - low[k])
            return out

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in keys], 1)
            side = batch.column("side").to_numpy()
            lost = np.logical_or.reduce([np.asarray(batch.column(a).is_null()) for a in AXES])
            p = np.stack([batch.column(a).fill_null(0).to_numpy() for a in AXES], 1)
            change = (key[1:] != key[:-1]).any(1) | (side[1:] != side[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if block is None or (key[lo] != block).any():
                    block, held, index = key[lo], [], None
                if side[lo] == 0:
                    held.append((numbered(p[lo:hi]), batch.column("v").slice(lo, hi - lo).to_numpy()))
                    continue
                if index is None:
                    index = indexed()
                for part, far in ((np.flatnonzero(~lost[lo:hi]) + lo, 0), (np.flatnonzero(lost[lo:hi]) + lo, 1)):
                    for k in range(0, len(part), few):
                        some = part[k : k + few]
                        objects = batch.column("object").take(pa.array(some))
                        if far:  # a centre without a place sees nothing
                            yield pa.RecordBatch.from_pydict({"object": objects, "v": pa.array([[0.0] * len(steps)] * len(some), pa.list_(pa.float64()))})
                        else:
                            yield from windows(objects, p[some])

    cut = rows.mapInArrow(run, f"object {kind}, v array<double>").select("object", F.posexplode("v").alias("_k", value)).where(F.col(value).isNotNull())
    ny, nz = width[1], width[2]
    offset = lambda c, n, lo: (c % n + lo).cast("int")
    dx, dy, dz = F.expr(f"_k div {ny * nz}"), F.expr(f"_k div {nz}"), F.col("_k")
    return cut.select("object", offset(dx, width[0], low[0]).alias("dx"), offset(dy, ny, low[1]).alias("dy"), offset(dz, nz, low[2]).alias("dz"), value)
