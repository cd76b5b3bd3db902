"""Operators that chains may name, each with the input that an output box needs.

A step works on voxel rows (x, y, z, v, and key columns that part them) and
knows the shape that it makes and, for a box of its output, the box of its
input. Folding these from the last step to the first tells, before any plan is
built, what a chain reads to make a chunk.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.specs import parse_chain
from gridloom.operators import filters, scalar, volumes

AXES = ("x", "y", "z")
Span = tuple[int, int]
Bounds = tuple[Span, Span, Span]
Shape = tuple[int, int, int]


@dataclass(frozen=True)
class Step:
    """``needs`` maps an output box to the input box, before it is cut at ``takes``; None where each voxel needs the whole volume."""

    name: str
    apply: Callable[[DataFrame, Sequence[str]], DataFrame]
    takes: Shape
    makes: Shape
    needs: Callable[[Bounds], Bounds] | None
    context: bool = False
    args: dict[str, Any] = field(default_factory=dict, hash=False)

    def input_box(self, box: Bounds) -> Bounds | None:
        if self.needs is None:
            return None
        return tuple((max(0, lo), min(n, max(lo, hi))) for (lo, hi), n in zip(self.needs(box), self.takes, strict=True))


OPS: dict[str, Callable[..., Step]] = {}


def operator(f: Callable[..., Step]) -> Callable[..., Step]:
    """Registers ``f(shape, ...)`` under its name (a trailing underscore apart)."""
    OPS[f.__name__.rstrip("_")] = f
    return f


def expand(box: Bounds, before: Sequence[int], after: Sequence[int], limits: Sequence[int] | None = None) -> tuple[Bounds, tuple[Span, ...]]:
    """A box with context on both sides, cut at 0 and ``limits``, and how much was cut off on each side."""
    if len({len(box), len(before), len(after)}) > 1 or (limits is not None and len(limits) != len(box)):
        raise ValueError("a width for each axis is needed")
    if min([*before, *after], default=0) < 0:
        raise ValueError("widths must not be negative")
    out, cut = [], []
    for k, ((lo, hi), b, a) in enumerate(zip(box, before, after, strict=True)):
        low, high = max(0, lo - b), hi + a if limits is None else min(limits[k], hi + a)
        out.append((low, high))
        cut.append((low - (lo - b), hi + a - high))
    return tuple(out), tuple(cut)


def _pointwise(name: str, shape: Shape, expression: Callable[[Column], Column], **args) -> Step:
    return Step(name, lambda df, keys: df.withColumn("v", expression(F.col("v"))), shape, shape, lambda box: box, args=args)


def _around(name: str, shape: Shape, reach: Sequence[int], apply, **args) -> Step:
    return Step(name, apply, shape, shape, lambda box: tuple((lo - r, hi + r) for (lo, hi), r in zip(box, reach, strict=True)), any(reach), args)


def _named(x: Any, y: Any, z: Any, none: Any) -> dict[str, Any]:
    return {a: v for a, v in zip(AXES, (x, y, z), strict=True) if v != none}


@operator
def cast(shape: Shape, source: str, target: str, rescale: bool = True) -> Step:
    return _pointwise("cast", shape, lambda c: scalar.cast_rescale(c, source, target, rescale))


@operator
def clip(shape: Shape, low: float | None = None, high: float | None = None) -> Step:
    return _pointwise("clip", shape, lambda c: scalar.clip(c, low, high))


@operator
def scale(shape: Shape, factor: float) -> Step:
    return _pointwise("scale", shape, lambda c: c * factor)


@operator
def log1p(shape: Shape) -> Step:
    return _pointwise("log1p", shape, F.log1p)


@operator
def threshold(shape: Shape, t: float) -> Step:
    return _pointwise("threshold", shape, lambda c: scalar.threshold(c, t))


@operator
def standardize(shape: Shape, mean: float, std: float) -> Step:
    return _pointwise("standardize", shape, lambda c: scalar.standardize(c, mean, std))


@operator
def rescale(shape: Shape, low_in: float, high_in: float, low_out: float, high_out: float) -> Step:
    return _pointwise("rescale", shape, lambda c: scalar.rescale(c, low_in, high_in, low_out, high_out))


@operator
def nan_replace(shape: Shape, fill: float = 0.0) -> Step:
    return _pointwise("nan_replace", shape, lambda c: scalar.nan_replace(c, fill))


@operator
def exposure(shape: Shape, how: str, high: float = 1.0, gamma: float = 1.0, gain: float = 1.0, cutoff: float = 0.5) -> Step:
    return _pointwise("exposure", shape, lambda c: filters.exposure(c, how, high, gamma, gain, cutoff))


@operator
def gaussian(shape: Shape, x: float = 0, y: float = 0, z: float = 0, truncate: float = 4.0) -> Step:
    reach = [len(filters.gaussian_weights(s, truncate)) - 1 if s > 0 else 0 for s in (x, y, z)]
    return _around("gaussian", shape, reach, lambda df, keys: filters.gaussian(df, _named(x, y, z, 0), truncate=truncate, keys=keys))


@operator
def unsharp(shape: Shape, x: float = 0, y: float = 0, z: float = 0, amount: float = 1.0, rounds: int = 1) -> Step:
    reach = [rounds * (len(filters.gaussian_weights(s)) - 1) if s > 0 else 0 for s in (x, y, z)]
    return _around("unsharp", shape, reach, lambda df, keys: filters.unsharp_mask(df, _named(x, y, z, 0), amount, rounds, keys=keys))


@operator
def box(shape: Shape, how: str, x: int = 0, y: int = 0, z: int = 0) -> Step:
    return _around("box", shape, (x, y, z), lambda df, keys: filters.box(df, _named(x, y, z, 0), how, keys=keys))


@operator
def percentile(shape: Shape, q: float, x: int = 1, y: int = 1) -> Step:
    return _around("percentile", shape, (x, y, 0), lambda df, keys: filters.percentile(df, x, y, q, keys=keys))


@operator
def median(shape: Shape, x: int = 1, y: int = 1) -> Step:
    return percentile(shape, 0.5, x, y)


@operator
def local_rank(shape: Shape, radius: int) -> Step:
    return _around("local_rank", shape, (radius, radius, 0), lambda df, keys: filters.local_rank(df, radius, keys=keys))


@operator
def down(shape: Shape, how: str = "mean", x: int = 1, y: int = 1, z: int = 1) -> Step:
    f = (x, y, z)
    needs = lambda box: tuple((lo * k, hi * k) for (lo, hi), k in zip(box, f, strict=True))
    return Step("down", lambda df, keys: volumes.downsample(df, dict(zip(AXES, f, strict=True)), how, keys=keys), shape, tuple(-(-n // k) for n, k in zip(shape, f, strict=True)), needs)


@operator
def up(shape: Shape, x: int = 1, y: int = 1, z: int = 1) -> Step:
    f = (x, y, z)
    needs = lambda box: tuple((lo // k, -(-hi // k)) for (lo, hi), k in zip(box, f, strict=True))
    return Step("up", lambda df, keys: volumes.upsample(df, _named(x, y, z, 1)), shape, tuple(n * k for n, k in zip(shape, f, strict=True)), needs)


@operator
def crop(shape: Shape, start: Sequence[int], size: Sequence[int]) -> Step:
    if any(s < 0 or n < 1 or s + n > m for s, n, m in zip(start, size, shape, strict=True)):
        raise ValueError(f"{start} and {size} leave {shape}")

    def apply(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        for a, s, n in zip(AXES, start, size, strict=True):
            df = df.where((F.col(a) >= s) & (F.col(a) < s + n)).withColumn(a, F.col(a) - s)
        return df

    return Step("crop", apply, shape, tuple(size), lambda box: tuple((lo + s, hi + s) for (lo, hi), s in zip(box, start, strict=True)))


@operator
def center_crop(shape: Shape, size: Sequence[int]) -> Step:
    return crop(shape, [round((n - s) / 2) for n, s in zip(shape, size, strict=True)], size)


@operator
def project(shape: Shape, dim: str, how: str) -> Step:
    k = AXES.index(dim)

    def apply(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return volumes.project(df, dim, how, axes=(*keys, *AXES)).withColumn(dim, F.lit(0).cast("bigint")).select(*keys, *AXES, "v")

    return Step("project", apply, shape, tuple(1 if i == k else n for i, n in enumerate(shape)), lambda box: tuple((0, shape[i]) if i == k else b for i, b in enumerate(box)), True)


@operator
def zscore(shape: Shape, dim: str | None = None) -> Step:
    if dim is None:
        return Step("zscore", lambda df, keys: volumes.zscore(df, None), shape, shape, None, True)
    k = AXES.index(dim)
    return Step("zscore", lambda df, keys: volumes.zscore(df, dim, axes=(*keys, *AXES)), shape, shape, lambda box: tuple((0, shape[i]) if i == k else b for i, b in enumerate(box)), True)


def build(chain: str | Sequence[Mapping[str, Any]], shape: Sequence[int], ops: Mapping[str, Callable[..., Step]] = OPS) -> list[Step]:
    """The steps of a chain, ``name(args) | name`` or [{"name": ..., "args": {...}}] (also as JSON), for a volume of ``shape`` (x, y, z)."""
    if isinstance(chain, str) and not chain.lstrip().startswith("["):
        named = parse_chain(chain, ops) if chain.strip() else []
    else:
        configs = json.loads(chain) if isinstance(chain, str) else chain
        if unknown := [c["name"] for c in configs if c["name"] not in ops]:
            raise ValueError(f"unknown operators {unknown}")
        named = [(ops[c["name"]], [], dict(c.get("args") or {})) for c in configs]
    steps, now = [], tuple(shape)
    for make, args, kw in named:
        try:
            inspect.signature(make).bind(now, *args, **kw)
        except TypeError as e:
            raise ValueError(f"{make.__name__}: {e}") from None
        steps.append(make(now, *args, **kw))
        now = steps[-1].makes
    return steps


def output_shape(steps: Sequence[Step], shape: Sequence[int]) -> Shape:
    return steps[-1].makes if steps else tuple(shape)


def input_box(steps: Sequence[Step], box: Bounds) -> Bounds | None:
    """What a chain reads to make ``box``; None for everything."""
    now: Bounds | None = box
    for step in reversed(steps):
        now = step.input_box(now)
        if now is None:
            return None
    return now


def apply(df: DataFrame, steps: Sequence[Step], keys: Sequence[str] = ()) -> DataFrame:
    for step in steps:
        df = step.apply(df, keys)
    return df.select(*keys, *AXES, "v")
