"""Neighbourhood filters over lines and planes of a gapless volume.

``keys`` of a filter name further columns that part the volume: channels, times, or pieces that do not touch.

A line of voxels along one axis is gathered as an array (bounded by that
axis's length); filters along an axis then need one exchange, and filters of a
plane exchange whole lines with the few lines beside them. No voxel is copied
to every centre within its reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def along(df: DataFrame, axis: str, body: Callable[[Column], Column], value: str = "v", axes: Sequence[str] = AXES) -> DataFrame:
    """Replaces each line along ``axis`` by ``body`` of its array, which may have another length; lines begin at their least coordinate."""
    others = [a for a in axes if a != axis]
    lines = df.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct(axis, value))).alias("_l"))
    lines = lines.select(*others, F.get("_l", F.lit(0))[axis].alias("_0"), F.transform("_l", lambda s: s[value]).alias("_v"))
    out = lines.select(*others, "_0", F.posexplode(body(F.col("_v"))).alias("_p", value))
    return out.select(*[(F.col("_0") + F.col("_p")).alias(a) if a == axis else F.col(a) for a in axes], value)


def mirrored(i: Column, n: Column) -> Column:
    """The place in 0..n - 1 that ``i`` mirrors to, the edge repeated (d c b a | a b c d | d c b a)."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights at distances 0, 1, ... of a sampled Gaussian that sums to one."""
    reach = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(reach + 1)]
    total = w[0] + 2 * sum(w[1:])
    return [x / total for x in w]


def gaussian(df: DataFrame, sigma: dict[str, float], value: str = "v", truncate: float = 4.0, keys: Sequence[str] = ()) -> DataFrame:
    """Separable Gaussian filter, mirrored at the border; axes that are not named stay as they are."""
    for axis, s in sigma.items():
        if s <= 0:
            continue
        weights = gaussian_weights(s, truncate)

        def smooth(v: Column, weights=weights) -> Column:
            def at(i: Column) -> Column:
                out = F.lit(0.0)
                for d in range(1 - len(weights), len(weights)):
                    out = out + weights[abs(d)] * F.get(v, mirrored(i + d, F.size(v)))
                return out

            return F.transform(v, lambda _, i: at(i))

        df = along(df, axis, smooth, value, (*keys, *AXES))
    return df.select(*keys, *AXES, value)


def unsharp_mask(df: DataFrame, sigma: dict[str, float], amount: float = 1.0, rounds: int = 1, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """v + amount * (v - its Gaussian), ``rounds`` times."""
    for _ in range(rounds):
        smooth = gaussian(df.select(*keys, *AXES, value), sigma, value, keys=keys).withColumnRenamed(value, "_s")
        df = df.join(smooth, [*keys, *AXES]).withColumn(value, F.col(value) + amount * (F.col(value) - F.col("_s"))).drop("_s")
    return df


def _reach(axis: str, r: int, keys: Sequence[str] = ()) -> Window:
    return Window.partitionBy(*keys, *[a for a in AXES if a != axis]).orderBy(axis).rangeBetween(-r, r)


def box(df: DataFrame, radius: dict[str, int], how: str, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """max, min, mean, sum or std (population) of each voxel's box, clipped at the border: running windows, one axis after the other."""
    if how in ("max", "min"):
        for axis, r in radius.items():
            df = df.withColumn(value, (F.max if how == "max" else F.min)(value).over(_reach(axis, r, keys)))
        return df.select(*keys, *AXES, value)
    out = df.select(*keys, *AXES, F.col(value).cast("double").alias("_1"), (F.col(value).cast("double") * F.col(value)).alias("_2"), F.lit(1).cast("bigint").alias("_n"))
    for axis, r in radius.items():
        w = _reach(axis, r, keys)
        out = out.select(*keys, *AXES, *[F.sum(c).over(w).alias(c) for c in ("_1", "_2", "_n")])
    mean = F.col("_1") / F.col("_n")
    result = {"sum": F.col("_1"), "mean": mean, "std": F.sqrt(F.greatest(F.col("_2") / F.col("_n") - mean * mean, F.lit(0.0)))}[how]
    return out.select(*keys, *AXES, result.alias(value))


def plane(df: DataFrame, reach: dict[int, int], body: Callable[[Column, Column], Column], value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """``body(values within reach, own value)`` of each voxel in its plane of x and y.

    ``reach`` gives, for each distance along y, how far the shape goes along x;
    it is clipped at the border. Each line goes once to every line that it is
    in reach of.
    """
    lines = df.groupBy(*keys, "y", "z").agg(F.sort_array(F.collect_list(F.struct("x", value))).alias("_l"))
    lines = lines.select(*keys, "y", "z", F.get("_l", F.lit(0))["x"].alias("_0"), F.transform("_l", lambda s: s[value]).alias("_v"))
    pairs = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(r).alias("r")) for d, r in sorted(reach.items())])
    sent = lines.withColumn("_p", F.explode(pairs)).select(*keys, (F.col("y") + F.col("_p.d")).alias("y"), "z", F.struct(F.col("_0").alias("x"), F.col("_p.r").alias("r"), F.col("_p.d").alias("d"), F.col("_v").alias("v")).alias("_s"))
    stacks = sent.groupBy(*keys, "y", "z").agg(F.collect_list("_s").alias("_s"), F.max(F.when(F.col("_s.d") == 0, F.struct("_s.x", "_s.v"))).alias("_own")).where("_own IS NOT NULL")

    def near(x: Column) -> Column:
        def cut(s: Column) -> Column:
            low = F.greatest(x - s["x"] - s["r"], F.lit(0))
            high = F.least(x - s["x"] + s["r"], F.size(s["v"]) - 1)
            return F.when(high >= low, F.slice(s["v"], (low + 1).cast("int"), (high - low + 1).cast("int"))).otherwise(F.slice(s["v"], 1, 0))

        return F.flatten(F.transform("_s", cut))

    done = F.transform("_own.v", lambda v, i: body(near(F.col("_own.x") + i), v))
    out = stacks.select(*keys, "y", "z", F.col("_own.x").alias("_0"), F.posexplode(done).alias("_i", value))
    return out.select(*keys, (F.col("_0") + F.col("_i")).alias("x"), "y", "z", value)


def percentile(df: DataFrame, rx: int, ry: int, q: float, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """The ``q`` quantile (linear between ranks) of each voxel's box in the plane; 0.5 is the median."""

    def body(values: Column, _: Column) -> Column:
        def pick(s: Column) -> Column:
            at = (F.size(s) - 1) * q
            low = F.get(s, F.floor(at).cast("int"))
            return low + (F.get(s, F.ceil(at).cast("int")) - low) * (at - F.floor(at))

        return _let(F.sort_array(values), pick)

    return plane(df, dict.fromkeys(range(-ry, ry + 1), rx), body, value, keys)


def disk(radius: int) -> dict[int, int]:
    """The reach of a disk, for :func:`plane`."""
    return {d: math.isqrt(radius * radius - d * d) for d in range(-radius, radius + 1)}


def local_rank(df: DataFrame, radius: int, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Local contrast by rank: 255 times the share of a disk's voxels that are at most the voxel itself."""
    return plane(df, disk(radius), lambda values, v: 255.0 * F.size(F.filter(values, lambda o: o <= v)) / F.size(values), value, keys)


def peaks(df: DataFrame, distance: int, least: float, border: int = 0, shape: Sequence[int] | None = None, value: str = "v") -> DataFrame:
    """``peak``: whether a voxel is above ``least`` and the greatest within ``distance`` in its plane, and not within ``border`` of its edge."""
    top = box(df, {"x": distance, "y": distance}, "max", value).withColumnRenamed(value, "_m")
    inside = F.lit(True)
    if border and shape is not None:
        for a, n in zip("xy", shape, strict=False):
            inside = inside & (F.col(a) >= border) & (F.col(a) < n - border)
    return df.join(top, list(AXES)).select(*AXES, ((F.col(value) == F.col("_m")) & (F.col(value) > least) & inside).alias("peak"))


def exposure(c: Column, how: str, high: float = 1.0, gamma: float = 1.0, gain: float = 1.0, cutoff: float = 0.5) -> Column:
    """gamma, log or sigmoid adjustment of values in 0..``high``."""
    unit = c / high
    if how == "gamma":
        return F.pow(unit, gamma) * high * gain
    if how == "log":
        return F.log2(1 + unit) * high * gain
    if how == "sigmoid":
        return high / (1 + F.exp(gain * (cutoff - unit)))
    raise ValueError(f"no exposure named {how!r}")


def equalized(df: DataFrame, low: float, high: float, bins: int = 256, value: str = "v") -> DataFrame:
    """Histogram equalisation over the whole volume: the share of voxels in the bins up to the voxel's own.

    The histogram has ``bins`` rows; the exact sums over it are broadcast.
    """
    slot = F.greatest(F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)), F.lit(0))
    placed = df.withColumn("_b", slot)
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    share = counts.select("_b", (F.sum("_n").over(every) / F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_s"))
    return placed.join(F.broadcast(share), "_b").withColumn(value, F.col("_s")).drop("_b", "_s")


def clahe(df: DataFrame, tile: tuple[int, int], shape: Sequence[int], clip: float = 0.01, bins: int = 64, high: float = 255.0, value: str = "v") -> DataFrame:
    """Contrast-limited adaptive histogram equalisation of each plane, to 0..``high``.

    Each tile has a histogram of ``bins``; counts above ``clip`` of the tile's
    voxels (one at least) are shared out over all bins. A voxel takes the sums of
    the four tiles around it, weighted by its place between their centres.
    """
    slot = F.greatest(F.least(F.floor(F.col(value) / high * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    placed = df.select(*AXES, slot.alias("_b"))
    counts = placed.groupBy("z", F.floor(F.col("x") / tile[0]).alias("_tx"), F.floor(F.col("y") / tile[1]).alias("_ty"), "_b").agg(F.count("*").alias("_n"))
    tiles = counts.groupBy("z", "_tx", "_ty").agg(F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_h"), F.sum("_n").alias("_all"))
    limit = F.greatest(F.lit(clip) * F.col("_all"), F.lit(1.0))
    tiles = tiles.withColumn("_limit", limit)
    whole = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("_h", b), F.lit(0)).cast("double"))
    tiles = tiles.withColumn("_c", whole).withColumn("_over", F.aggregate("_c", F.lit(0.0), lambda a, c: a + F.greatest(c - F.col("_limit"), F.lit(0.0))))
    sums = F.aggregate(
        "_c",
        F.array().cast("array<double>"),
        lambda a, c: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + F.least(c, F.col("_limit")) + F.col("_over") / bins)),
    )
    tiles = tiles.select("z", "_tx", "_ty", F.transform(sums, lambda s: s / F.col("_all") * high).alias("_map"))
    last = [-(-n // t) - 1 for n, t in zip(shape, tile, strict=False)]

    def beside(axis: str, k: int) -> Column:
        """(tile, weight) of the two tiles around along an axis."""
        f = (F.col(axis) - (tile[k] - 1) / 2) / tile[k]
        low = F.floor(f)
        inside = lambda t: F.greatest(F.least(t, F.lit(last[k])), F.lit(0))
        return F.array(F.struct(inside(low).alias("t"), (1 - (f - low)).alias("w")), F.struct(inside(low + 1).alias("t"), (f - low).alias("w")))

    near = placed.withColumn("_i", F.explode(beside("x", 0))).withColumn("_j", F.explode(beside("y", 1)))
    near = near.select(*AXES, "_b", F.col("_i.t").alias("_tx"), F.col("_j.t").alias("_ty"), (F.col("_i.w") * F.col("_j.w")).alias("_w"))
    return near.join(tiles, ["z", "_tx", "_ty"]).groupBy(*AXES).agg(F.sum(F.col("_w") * F.get("_map", F.col("_b"))).alias(value))


def contrast_limited(df: DataFrame, radius: int, mean_factor: float = 3.0, limit: float = 10.0, gamma: float = 0.5, high: float = 255.0, value: str = "v") -> DataFrame:
    """Local contrast with a limited slope, from the mean and sample deviation of each voxel's box in the plane, to 0..255.

    Only voxels whose box lies within the plane have one; the others are 0.
    """
    n = (2 * radius + 1) ** 2
    out = df.select(*AXES, (F.col(value) / high).alias("_v"), (F.col(value) / high).alias("_1"), (F.col(value) / high * F.col(value) / high).alias("_2"), F.lit(1).cast("bigint").alias("_n"))
    for axis in "xy":
        w = _reach(axis, radius)
        out = out.select(*AXES, "_v", *[F.sum(c).over(w).alias(c) for c in ("_1", "_2", "_n")])
    mean = F.col("_1") / n
    std = F.sqrt(F.greatest((F.col("_2") - n * mean * mean) / (n - 1), F.lit(0.0)))
    bend = gamma ** (1 / (1 - gamma))
    slope = 1 / (mean_factor * F.col("_d"))
    slope = F.when(slope >= limit, F.pow(slope + bend - limit, F.lit(gamma)) + limit - bend**gamma).otherwise(slope)
    out = out.withColumns({"_m": mean, "_d": std}).withColumn("_s", F.when(F.col("_d") > 0, slope).otherwise(0.0))
    low = F.when(F.col("_s") > 0, F.col("_m") - 1 / F.col("_s")).otherwise(0.0)
    result = F.greatest(F.least((F.col("_v") - low) * F.col("_s") * 0.5 * 255, F.lit(255.0)), F.lit(0.0))
    return out.select(*AXES, F.when(F.col("_n") == n, F.floor(result)).otherwise(0).cast("int").alias(value))


def interpolated(df: DataFrame, axis: str, size: int, value: str = "v") -> DataFrame:
    """Each line along ``axis`` resampled to ``size`` places from its first voxel to its last, linear between voxels."""

    def body(v: Column) -> Column:
        def at(i: Column) -> Column:
            p = i * (F.size(v) - 1) / max(size - 1, 1)
            low = F.get(v, F.floor(p).cast("int"))
            return low + (F.get(v, F.ceil(p).cast("int")) - low) * (p - F.floor(p))

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)

    return along(df, axis, body, value)


def center_crop(df: DataFrame, shape: Sequence[int], size: Sequence[int], value: str = "v") -> DataFrame:
    """The middle ``size`` voxels of a volume of ``shape``, from round((n - size) / 2), halves to even; coordinates begin at 0."""
    for a, n, s in zip(AXES, shape, size, strict=True):
        start = round((n - s) / 2)
        df = df.where((F.col(a) >= start) & (F.col(a) < start + s)).withColumn(a, F.col(a) - start)
    return df.select(*AXES, value)


def pad_symmetrically(df: DataFrame, shape: Sequence[int], size: Sequence[int], fill: float = 0.0, value: str = "v") -> DataFrame:
    """The volume in the middle of one of ``size`` voxels filled with ``fill``; an odd voxel goes after it.

    The grid is generated in parallel by lines of x.
    """
    before = [(s - n) // 2 for n, s in zip(shape, size, strict=True)]
    lines = df.sparkSession.range(size[1] * size[2]).select((F.col("id") % size[1]).alias("y"), F.floor(F.col("id") / size[1]).alias("z"))
    grid = lines.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size[0] - 1).cast("bigint"))))
    moved = df.select(*[(F.col(a) + b).alias(a) for a, b in zip(AXES, before, strict=True)], value)
    return grid.join(moved, list(AXES), "left").select(*AXES, F.coalesce(value, F.lit(fill)).alias(value))


def box_total(df: DataFrame, start: Sequence[int], end: Sequence[int], value: str = "v") -> DataFrame:
    """The sum over one half-open box: a single row, 0 if the box is empty. The filter reaches the scan."""
    for a, lo, hi in zip(AXES, start, end, strict=True):
        df = df.where((F.col(a) >= lo) & (F.col(a) < hi))
    return df.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
