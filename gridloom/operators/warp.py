"""Resampling by affine maps: each place of the output looks where it comes from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.runs import Report, missing_chunks, output_spec
from gridloom.sources import arrays
from gridloom.sources.shared import materialized

AXES = ("x", "y", "z")
KERNELS, BORDERS = ("nearest", "linear", "cubic"), ("constant", "replicate", "reflect")


def inverse_map(matrix: Sequence[Sequence[float]], inverted: bool = False) -> np.ndarray:
    """A 3 x 4 map from output to source places (x, y, z), of a 2 x 3 map of planes or a 3 x 4 map of volumes from source to output; ``inverted``: it leads from output to source already."""
    m = np.array(matrix, dtype=float)
    if m.shape not in ((2, 3), (3, 4)):
        raise ValueError(f"a map of 2 x 3 or 3 x 4 is needed, not {m.shape}")
    whole = np.eye(4)
    n = len(m)
    whole[:n, :n], whole[:n, 3] = m[:, :n], m[:, n]
    if not inverted:
        if abs(np.linalg.det(whole)) < 1e-12:
            raise ValueError("the map has no inverse")
        whole = np.linalg.inv(whole)
    return whole[:3]


def taps(kernel: str, t: Any) -> list[tuple[int, Any]]:
    """(place relative to the floor, weight) of a kernel for the fraction ``t`` beyond the floor; t may be a Column or an array."""
    if kernel == "linear":
        return [(0, 1 - t), (1, t)]
    if kernel != "cubic":
        raise ValueError(f"unknown kernel {kernel!r}, not one of {KERNELS}")
    a = -0.75
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [(-1, far(1 + t)), (0, near(t)), (1, near(1 - t)), (2, far(2 - t))]




def warp(df: DataFrame, shape: Sequence[int], matrix: Sequence[Sequence[float]], kernel: str = "linear", border: str = "constant", constant: float = 0.0, inverted: bool = False, out_shape: Sequence[int] | None = None, value: str = "v") -> DataFrame:
    """x, y, z, value of a voxel table of ``shape`` (from 0) under an affine map.

    Nearest rounds halves up; linear and cubic (a = -0.75) weigh 2 or 4 voxels
    along each axis that the map changes. Beyond the volume stands
    ``constant``, the nearest voxel (replicate) or the mirrored one, the edge
    repeated (reflect); a voxel without a row or with a null is ``constant``.
    Each output place joins the few source places that it needs by their
    coordinates; the grid is made in parallel.
    """
    if border not in BORDERS or kernel not in KERNELS:
        raise ValueError(f"border {border!r} or kernel {kernel!r} is unknown")
    back = inverse_map(matrix, inverted)
    out = tuple(out_shape or shape)
    n = F.col("id")
    at = [n % out[0], F.floor(n / out[0]) % out[1], F.floor(n / (out[0] * out[1]))]
    grid = df.sparkSession.range(int(np.prod(out))).select(*[c.cast("bigint").alias(a) for c, a in zip(at, AXES, strict=True)])
    weight: Column = F.lit(1.0)
    rows = grid
    for k, axis in enumerate(AXES):
        place = sum((float(back[k][i]) * F.col(AXES[i]) for i in range(3) if back[k][i]), F.lit(float(back[k][3])))
        if list(back[k]) == [float(i == k) for i in range(4)]:
            rows = rows.withColumn(f"_s{axis}", F.col(axis))
        elif kernel == "nearest":
            rows = rows.withColumn(f"_s{axis}", F.floor(F.round(place, 9) + 0.5).cast("bigint"))
        else:
            rows = rows.withColumn("_p", F.round(place, 9)).withColumn("_f", F.floor("_p").cast("bigint"))
            each = [F.struct((F.col("_f") + d).alias("s"), w.alias("w")) for d, w in taps(kernel, F.col("_p") - F.col("_f"))]
            rows = rows.withColumn(f"_t{axis}", F.explode(F.filter(F.array(*each), lambda e: e["w"] != 0))).withColumn(f"_s{axis}", F.col(f"_t{axis}.s"))
            weight = weight * F.col(f"_t{axis}.w")
        if border == "replicate":
            rows = rows.withColumn(f"_s{axis}", F.greatest(F.lit(0), F.least(F.col(f"_s{axis}"), F.lit(shape[k] - 1))).cast("bigint"))
        elif border == "reflect":
            m = F.pmod(F.col(f"_s{axis}"), F.lit(2 * shape[k]))
            rows = rows.withColumn(f"_s{axis}", F.when(m < shape[k], m).otherwise(2 * shape[k] - 1 - m).cast("bigint"))
    rows = rows.select(*AXES, *[f"_s{a}" for a in AXES], weight.alias("_w"))
    source = df.select(*[F.col(a).cast("bigint").alias(f"_s{a}") for a in AXES], F.col(value).cast("double").alias("_v"))
    met = rows.join(source, [f"_s{a}" for a in AXES], "left").withColumn("_v", F.coalesce("_v", F.lit(float(constant))))
    if kernel == "nearest":
        return met.select(*AXES, F.col("_v").alias(value))
    return met.groupBy(*AXES).agg(F.sum(F.col("_w") * F.col("_v")).alias(value))


def _outside(places: np.ndarray, n: int, border: str) -> tuple[np.ndarray, np.ndarray]:
    """Places brought into 0..n - 1, and whether they were there."""
    inside = (places >= 0) & (places < n)
    if border == "reflect":
        m = places % (2 * n)
        return np.where(m < n, m, 2 * n - 1 - m), np.ones_like(inside)
    return np.clip(places, 0, n - 1), inside | (border == "replicate")


def warp_array(
    spark: SparkSession, source: str, target: str, matrix: Sequence[Sequence[float]], kernel: str = "linear", border: str = "constant", constant: float = 0.0, inverted: bool = False,
    out_shape: Sequence[int] | None = None, overrides: Mapping[str, Any] | None = None, channel: int = 0, resume: bool = True,
) -> Report:
    """:func:`warp` of a stored array into another one, chunk by chunk: each task finds the source box of its output chunk by the inverse map and reads that.

    No row is shuffled; a task holds one output chunk with its source box.
    Chunks that are there already are left with ``resume``. Integer types round
    half to even and are clipped to their range.
    """
    if border not in BORDERS or kernel not in KERNELS:
        raise ValueError(f"border {border!r} or kernel {kernel!r} is unknown")
    spec, back = arrays.open_array(source), inverse_map(matrix, inverted)
    shape = tuple(spec.shape[spec.axes.index(a)] for a in AXES)
    out = arrays.create_array(output_spec(spec, target, tuple(out_shape or shape), overrides), delete_existing=not resume)
    missing = materialized(missing_chunks(spark, out), "missing")
    order = [a for a in spec.axes if a in AXES]
    kind = np.dtype(out.dtype)

    def make(index: tuple[int, ...]) -> np.ndarray:
        spans = dict(zip(out.axes, out.extent(index), strict=True))
        at = np.meshgrid(*[np.arange(*spans[a]) for a in order], indexing="ij")
        place = dict(zip(order, at, strict=True))
        source_at = {a: np.round(sum(back[k][i] * place[AXES[i]] for i in range(3)) + back[k][3], 9) for k, a in enumerate(AXES)}
        each = {}
        for k, a in enumerate(AXES):
            low = np.floor(source_at[a] + (0.5 if kernel == "nearest" else 0)).astype(np.int64)
            plain = list(back[k]) == [float(i == k) for i in range(4)]
            each[a] = [(0, np.ones(low.shape))] if kernel == "nearest" or plain else taps(kernel, source_at[a] - low)
            each[a] = [(*_outside(low + d, shape[k], border), w) for d, w in each[a]]
        bounds = {a: (min(int(p.min()) for p, _, _ in each[a]), max(int(p.max()) for p, _, _ in each[a]) + 1) for a in AXES}
        full = [bounds.get(a, (channel, channel + 1)) for a in spec.axes]
        block = arrays.read_block(spec, spec.files(), [lo for lo, _ in full], [hi for _, hi in full])
        block = block.reshape([hi - lo for (lo, hi), a in zip(full, spec.axes, strict=True) if a in AXES]).astype(float)
        total = np.zeros(at[0].shape)
        for way in product(*(each[a] for a in order)):
            values = block[tuple(p - bounds[a][0] for a, (p, _, _) in zip(order, way, strict=True))]
            inside = np.logical_and.reduce([i for _, i, _ in way])
            total += np.where(inside, values, constant) * np.prod([w for _, _, w in way], axis=0)
        if kind.kind in "iu":
            total = np.clip(np.rint(total), np.iinfo(kind).min, np.iinfo(kind).max)
        return total.reshape([hi - lo for lo, hi in out.extent(index)]).astype(kind)

    n = missing.count()
    if n:
        arrays.write_blocks(missing.repartition(min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))), target, make)
    return Report(int(np.prod(out.grid)), n, n, None)
