"""Exact distance transforms by lines, and what follows from them: growing labels to their nearest voxels, erosion by a radius.

A squared distance is a sum over axes, so the nearest seed is found an axis at
a time: each line of voxels meets in one row and gets the lower envelope of
the parabolas (Euclid) or cones (city block) that stand on its voxels. A line
is as long as its axis; nothing else is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Label of a place that no seed is nearest to.
NONE = np.int64(2**63 - 1)
#: Voxels that are worked on at once.
AT_ONCE = 1 << 20


def _less(v: np.ndarray, near: np.ndarray, w: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (w < v) | ((w == v) & (other < near))


def envelope(p: np.ndarray, f: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min over j of f[j] + (p[i] - p[j])^2 and the least ``near`` of those that attain it, for all lines (rows) at once.

    ``p`` rises along each line. Parabolas enter from left to right; one goes
    if its neighbours meet before it does. Those that only touch the envelope
    stay, so that equal distances are told apart by label.
    """
    lines, n = p.shape
    row = np.arange(lines)
    stack = np.zeros((lines, n), np.int64)
    since = np.full((lines, n + 1), np.inf)  # where each parabola of the stack takes over
    top = np.full(lines, -1)
    for q in range(n):
        open_ = row[np.isfinite(f[:, q])]
        while len(open_):
            has = top[open_] >= 0
            first = open_[~has]
            top[first], stack[first, 0], since[first, 0] = 0, q, -np.inf
            open_ = open_[has]
            k = stack[open_, top[open_]]
            meet = ((f[open_, q] + p[open_, q] ** 2) - (f[open_, k] + p[open_, k] ** 2)) / (2 * (p[open_, q] - p[open_, k]))
            gone = meet < since[open_, top[open_]]
            stay = open_[~gone]
            top[stay] += 1
            stack[stay, top[stay]], since[stay, top[stay]] = q, meet[~gone]
            open_ = open_[gone]
            top[open_] -= 1
    since[row, top + 1] = np.inf
    out, label = np.full((lines, n), np.inf), np.full((lines, n), NONE)
    some = row[top >= 0]
    at = np.zeros(lines, np.int64)
    for i in range(n):
        live = some
        while len(live := live[since[live, at[live] + 1] < p[live, i]]):
            at[live] += 1
        live, k = some, at[some].copy()
        while len(live):
            j = stack[live, k]
            v = f[live, j] + (p[live, i] - p[live, j]) ** 2
            better = _less(out[live, i], label[live, i], v, near[live, j])
            out[live[better], i], label[live[better], i] = v[better], near[live, j][better]
            more = since[live, k + 1] <= p[live, i]
            live, k = live[more], k[more] + 1
    return out, label


def cones(p: np.ndarray, f: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with |p[i] - p[j]|: one pass from each end."""
    out, label = f.copy(), near.copy()
    for order in (range(1, p.shape[1]), range(p.shape[1] - 2, -1, -1)):
        step = 1 if order.step == 1 else -1
        for i in order:
            v = out[:, i - step] + np.abs(p[:, i] - p[:, i - step])
            better = _less(out[:, i], label[:, i], v, label[:, i - step])
            out[better, i], label[better, i] = v[better], label[better, i - step]
    return out, label


def _along(df: DataFrame, axis: str, width: float, rule) -> DataFrame:
    """One axis of a transform: x, y, z, label, near, d of each voxel."""
    others = [a for a in AXES if a != axis]
    lines = df.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct(F.col(axis).alias("p"), "label", "near", "d"))).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = batch.column("line")
            flat = line.flatten()
            sizes = np.diff(line.offsets.to_numpy())
            p, label, near, d = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            starts = np.cumsum(sizes) - sizes
            done, best = np.empty(len(p)), np.empty(len(p), np.int64)
            for n in np.unique(sizes):
                mine = starts[sizes == n]
                for lo in range(0, len(mine), max(1, AT_ONCE // n)):
                    at = mine[lo : lo + max(1, AT_ONCE // n), None] + np.arange(n)
                    done[at], best[at] = rule(p[at] * float(width), d[at], near[at])
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = {axis: pa.array(p)} | {a: batch.column(a).take(of) for a in others} | {"label": pa.array(label), "near": pa.array(best), "d": pa.array(done)}
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in (*AXES, "label", "near", "d")})

    return lines.mapInArrow(run, "x bigint, y bigint, z bigint, label bigint, near bigint, d double")


def nearest(df: DataFrame, seeds: Column, voxel: Mapping[str, float], label: str = "label", city_block: bool = False) -> DataFrame:
    """x, y, z, label, near, d: the label of the nearest seed of each voxel and its squared Euclidean (or plain city-block) distance.

    ``voxel`` gives the voxel's size along each axis to be used; along others
    no distance is travelled. Of equally near seeds the least label counts. A
    voxel that no seed can be reached from has null ``near`` and ``d``; null
    labels are 0; voxels with a null coordinate are left out. In a volume with
    gaps a distance travels by lines of voxels that are there.
    """
    rows = df.dropna(subset=list(AXES)).select(*[F.col(a).cast("bigint").alias(a) for a in AXES], F.coalesce(F.col(label), F.lit(0)).cast("bigint").alias("label"), F.coalesce(seeds, F.lit(False)).alias("_s"))
    out = rows.select(*AXES, "label", F.when(F.col("_s"), F.col("label")).otherwise(F.lit(int(NONE))).alias("near"), F.when(F.col("_s"), 0.0).otherwise(F.lit(float("inf"))).alias("d"))
    for axis, width in voxel.items():
        if width <= 0:
            raise ValueError(f"a voxel of {width} along {axis}")
        out = _along(out, axis, width, cones if city_block else envelope)
    far = F.col("d") == float("inf")
    return out.select(*AXES, "label", F.when(~far, F.col("near")).alias("near"), F.when(~far, F.col("d")).alias("d"))


def distance_map(df: DataFrame, voxel: Mapping[str, float], label: str = "label") -> DataFrame:
    """x, y, z, distance of each voxel to the nearest one with a label; 0 within labels, null without any."""
    return nearest(df, F.col(label) != 0, voxel, label).select(*AXES, F.sqrt("d").alias("distance"))


def expand_labels(df: DataFrame, voxel: Mapping[str, float], most: float | None = None, mask: Column | None = None, label: str = "label") -> DataFrame:
    """x, y, z, label, distance: empty voxels take the label of the nearest labelled one.

    No farther than ``most``, and only where ``mask`` holds (a column of
    ``df``; null is false); other voxels keep what they have. ``distance`` is
    that to the nearest label before growing.
    """
    found = nearest(df, F.col(label) != 0, voxel, label)
    fine = F.col("d").isNotNull()
    if most is not None:
        fine = fine & (F.sqrt("d") <= most)
    if mask is not None:
        found = found.join(df.select(*[F.col(a).cast("bigint").alias(a) for a in AXES], F.coalesce(mask, F.lit(False)).alias("_m")), list(AXES))
        fine = fine & F.col("_m")
    return found.select(*AXES, F.when(fine, F.col("near")).otherwise(F.col("label")).alias("label"), F.sqrt("d").alias("distance"))


def separated(df: DataFrame, axes: Sequence[str] = AXES, label: str = "label") -> DataFrame:
    """Empties voxels whose neighbour before them, along each axis in turn, has another label that is not 0."""
    for axis in axes:
        w = Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)
        beside = F.lag(axis).over(w) == F.col(axis) - 1
        before = F.lag(label).over(w)
        df = df.withColumn(label, F.when(beside & (before != F.col(label)) & (before != 0), F.lit(0)).otherwise(F.col(label)).cast("bigint"))
    return df


def eroded(df: DataFrame, radius: int = 2, min_size: int = 50, axes: Sequence[str] = AXES, label: str = "label") -> DataFrame:
    """x, y, z, label: a gap of one voxel between labels, then all within ``radius`` of an empty voxel becomes empty.

    Labels of ``min_size`` voxels or fewer stay as they were. ``axes`` names
    those of a plane or of the volume; what lies outside does not erode.
    """
    rows = df.select(*AXES, F.coalesce(F.col(label), F.lit(0)).cast("bigint").alias("_was"))
    apart = separated(rows.withColumn("label", F.col("_was")), axes)
    if radius > 0:
        # both labels travel as one number's place: the one after the gap decides, the one before comes back by a join
        far = nearest(apart, F.col("label") == 0, dict.fromkeys(axes, 1.0), "label")
        kept = far.select(*AXES, F.when(F.col("d").isNull() | (F.col("d") > radius * radius), F.col("label")).otherwise(0).alias("label"))
        apart = kept.join(rows, list(AXES))
    sizes = rows.groupBy("_was").agg(F.count("*").alias("_n")).where(F.col("_n") <= min_size).select(F.col("_was").alias("_small"))
    both = apart.join(sizes, F.col("_was") == F.col("_small"), "left")
    return both.select(*AXES, F.when(F.col("_small").isNotNull(), F.col("_was")).otherwise(F.col("label")).cast("bigint").alias("label"))


def eroded_objects(df: DataFrame, rounds: int, min_count: int = 0, label: str = "label") -> DataFrame:
    """x, y, z, label: each object loses its outermost voxels ``rounds`` times, or fewer if less than ``min_count`` of it would be left.

    A voxel is outermost if a face neighbour is of another object or outside
    of the volume; after k rounds those are left that are more than k steps
    from any such place, so one city-block transform replaces all rounds.
    """
    rows = df.select(*AXES, F.coalesce(F.col(label), F.lit(0)).cast("bigint").alias("label"))
    inner = F.lit(True)
    for axis in AXES:
        w = Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)
        for step, beside in ((1, F.lag), (-1, F.lead)):
            inner = inner & F.coalesce((beside(axis).over(w) == F.col(axis) - step) & (beside("label").over(w) == F.col("label")), F.lit(False))
    deep = nearest(rows.withColumn("_edge", ~inner), F.col("_edge"), dict.fromkeys(AXES, 1.0), city_block=True)
    deep = deep.select(*AXES, "label", (F.coalesce("d", F.lit(1e18)) + 1).alias("d")).where("label <> 0")
    # voxels left after k rounds, for each k at most ``rounds``; the first k that leaves too few ends it
    levels = deep.select("label", F.least(F.col("d") - 1, F.lit(float(rounds))).cast("int").alias("k")).groupBy("label", "k").agg(F.count("*").alias("n"))
    steps = F.sequence(F.lit(0), F.lit(rounds))
    table = levels.groupBy("label").agg(F.collect_list(F.struct("k", "n")).alias("t"))  # rounds + 1 entries at most
    left = F.transform(steps, lambda k: F.aggregate(F.filter("t", lambda e: e["k"] >= k), F.lit(0).cast("bigint"), lambda a, e: a + e["n"]))
    done = F.size(F.filter(F.slice(left, 2, max(rounds, 1)), lambda n: n >= min_count)) if rounds else F.lit(0)
    both = deep.join(table.select("label", done.alias("done")), "label")
    kept = both.where(F.col("d") > F.col("done")).select(*AXES, F.col("label").alias("_kept"))
    return rows.join(kept, list(AXES), "left").select(*AXES, F.coalesce("_kept", F.lit(0)).cast("bigint").alias("label"))
