"""Subvolumes with a halo: any function of a block, run chunk by chunk, and runs that store and resume."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.specs import Op, apply_chain
from gridloom.sources import volumes as store

AXES = ("x", "y", "z")


def with_halo(df: DataFrame, size: Sequence[int], halo: Sequence[int], value: str = "v") -> DataFrame:
    """cx, cy, cz, x, y, z, value: each voxel in every chunk that it lies in or within ``halo`` of.

    A voxel goes to its own chunk, and only those near a face go to others, so
    little is copied where the halo is small beside the chunk.
    """
    out = df.select(*AXES, value)
    for a, s, h in zip(AXES, size, halo, strict=True):
        low, high = F.floor((F.col(a) - h) / s), F.floor((F.col(a) + h) / s)
        out = out.withColumn(f"c{a}", F.explode(F.sequence(low, high)))
    own = df.select(*[F.floor(F.col(a) / s).alias(f"c{a}") for a, s in zip(AXES, size, strict=True)]).distinct()
    return out.join(own, [f"c{a}" for a in AXES], "left_semi")


def expected_output(start: Sequence[int], end: Sequence[int], before: Sequence[int], after: Sequence[int], cropped: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The half-open box that a processor with this context returns for an input box."""
    if not cropped:
        return tuple(start), tuple(end)
    return tuple(s + b for s, b in zip(start, before, strict=True)), tuple(max(e - a, s + b) for s, e, b, a in zip(start, end, before, after, strict=True))


def process(df: DataFrame, size: Sequence[int], halo: Sequence[int], body: Callable[[np.ndarray], np.ndarray], fill: float = 0.0, value: str = "v") -> DataFrame:
    """Runs ``body`` on the dense block (x, y, z) of each chunk with its halo and keeps the chunk's own voxels.

    The block spans the voxels there are; missing ones within it are ``fill``.
    ``body`` returns a block of the same shape. A task holds one chunk.
    """

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        at = p[list(AXES)].to_numpy()
        origin = at.min(axis=0)
        block = np.full(at.max(axis=0) - origin + 1, fill)
        place = tuple((at - origin).T)
        block[place] = p[value].to_numpy()
        done = body(block)
        if done.shape != block.shape:
            raise ValueError(f"a block of {block.shape} became one of {done.shape}")
        mine = (at // np.array(size) == np.array(key)).all(axis=1)
        return pd.DataFrame({**{a: at[mine, k] for k, a in enumerate(AXES)}, value: done[place][mine].astype(float)})

    chunks = with_halo(df, size, halo, value)
    return chunks.groupBy("cx", "cy", "cz").applyInPandas(run, f"x bigint, y bigint, z bigint, {value} double")


def materialize(df: DataFrame, chain: str, ops: Mapping[str, Op], path: str, chunk: Sequence[int], resume: bool = True, value: str = "v") -> DataFrame:
    """Applies a chain of operators and stores the result as chunks at ``path``; with ``resume``, only chunks that are not there yet. Returns a reader of all of them."""
    out = apply_chain(df, chain, ops)
    store.write_chunks(store.to_chunks(out, chunk, value), path, resume)
    return df.sparkSession.read.parquet(path)


def stored_pyramid(df: DataFrame, levels: Sequence[dict[str, int]], down: Callable[[DataFrame, dict[str, int]], DataFrame], path: str, chunk: Sequence[int], value: str = "v") -> list[DataFrame]:
    """Stores every level of a pyramid at ``path``/0, 1, ...; each level is made from the one before, whose factors must divide its own."""
    made, now, before = [], df.select(*AXES, value), dict.fromkeys(AXES, 1)
    for k, factors in enumerate([{}, *levels]):
        whole = {a: factors.get(a, 1) for a in AXES}
        if any(whole[a] % before[a] for a in AXES):
            raise ValueError(f"level {k} is no whole multiple of the one before")
        now = down(now, {a: whole[a] // before[a] for a in AXES}) if k else now
        store.write_chunks(store.to_chunks(now, chunk, value), f"{path}/{k}")
        now, before = store.from_chunks(df.sparkSession.read.parquet(f"{path}/{k}"), chunk, value), whole
        made.append(now)
    return made


def in_any_box(df: DataFrame, boxes: Sequence[tuple[Sequence[int], Sequence[int]]]) -> DataFrame:
    """Voxels within one of a caller's half-open boxes; all of them if there are none."""
    if not boxes:
        return df
    tests = [reduce(lambda p, q: p & q, [(F.col(a) >= lo) & (F.col(a) < hi) for a, lo, hi in zip(AXES, start, end, strict=True)]) for start, end in boxes]
    return df.where(reduce(lambda p, q: p | q, tests))
