"""Splits, folds and stratified samples. Order comes from md5 of the id, so every engine agrees."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: int, *ids: str) -> Column:
    """A reproducible pseudo-random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def ranked(df: DataFrame, ids: str, label: str, seed: int = 0) -> DataFrame:
    """Adds ``_k``, the place of a row (from 0) in the shuffled order of its label, and ``_n``, the label's size.

    Rows are numbered within the 4,096 ranges of the order's first digits and
    shifted by the sizes of the ranges before: no task orders a whole label.
    """
    placed = df.withColumn("_h", shuffled(seed, ids)).withColumn("_b", F.substring("_h", 1, 3))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(label, "_b").agg(F.count("*").alias("_m"))
    shifts = sizes.select(F.col(label).alias("_l"), F.col("_b").alias("_r"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_s"), F.sum("_m").over(Window.partitionBy(label)).alias("_n"))
    own = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", ids)) - 1
    met = placed.withColumn("_k", own).join(shifts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_r")))
    return met.withColumn("_k", F.col("_k") + F.col("_s")).drop("_h", "_b", "_l", "_r", "_s")


def stratified_split(df: DataFrame, ids: str, label: str, ratios: Sequence[float], names: Sequence[str], seed: int = 0) -> DataFrame:
    """Adds ``split``: of each label, int(ratio * n) rows to each name in turn and the rest to the last."""
    if len(names) != len(ratios) + 1 or sum(ratios) > 1:
        raise ValueError("one more name than ratios, which add up to 1 at most")
    rank, n, out, start = F.col("_k"), F.col("_n"), F.lit(names[-1]), F.lit(0)
    ends = []
    for r in ratios:
        start = start + F.floor(F.lit(r) * n)
        ends.append(start)
    for name, end in reversed(list(zip(names, ends, strict=False))):
        out = F.when(rank < end, F.lit(name)).otherwise(out)
    return ranked(df, ids, label, seed).withColumn("split", out).drop("_k", "_n")


def folds(df: DataFrame, ids: str, label: str | None, n: int, seed: int = 0) -> DataFrame:
    """Adds ``fold`` 0..n-1, balanced within labels; every id validates once."""
    if label is None:  # ranks within hash groups, so that no task orders all ids
        return df.withColumn("fold", F.pmod(F.conv(F.substring(shuffled(seed, ids), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int"))
    return ranked(df, ids, label, seed).withColumn("fold", (F.col("_k") % n).cast("int")).drop("_k", "_n")


def rotated(df: DataFrame, n: int, valid: int = 1, test: int = 1) -> DataFrame:
    """A row for each of n rotations: ``rotation`` and ``split`` of each fold."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = df.withColumn("rotation", k).withColumn("_p", F.pmod(F.col("fold") - F.col("rotation"), F.lit(n)))
    return out.withColumn("split", F.when(F.col("_p") < test, "test").when(F.col("_p") < test + valid, "valid").otherwise("train")).drop("_p")


def concatenated(parts: Sequence[tuple[DataFrame, int]], ids: str) -> DataFrame:
    """Union of data sets, the ids of each shifted by the lengths of those before."""
    out, offset = None, 0
    for df, length in parts:
        moved = df.withColumn(ids, F.col(ids) + offset)
        out, offset = moved if out is None else out.unionByName(moved), offset + length
    return out


def repeated(df: DataFrame, ids: str, factor: int, length: int) -> DataFrame:
    """Every row ``factor`` times, its id shifted by ``length`` each time."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(ids, F.col(ids) + F.col("_i") * length).drop("_i")


def balanced(df: DataFrame, ids: str, label: str, seed: int = 0) -> DataFrame:
    """Oversamples every class to the size of the largest: whole repeats and a sampled rest; ``copy`` tells repeats apart."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    top = sizes.agg(F.max("_n").alias("_top"))
    both = ranked(df, ids, label, seed).crossJoin(F.broadcast(top))  # one row
    copies = F.floor(F.col("_top") / F.col("_n")) + (F.col("_k") < F.col("_top") % F.col("_n")).cast("int")
    return both.withColumn("_c", copies).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("_c") - 1).cast("int")))).drop("_c", "_k", "_n", "_top")


def sample_each(df: DataFrame, ids: str, label: str, n: int, guarantee: int = 1, seed: int = 0) -> DataFrame:
    """About ``n`` rows in the classes' proportions, ``guarantee`` of each class at least."""
    total = df.agg(F.count("*").alias("_t"))
    share = F.floor(F.col("_n") * n / F.col("_t"))
    placed = ranked(df, ids, label, seed).crossJoin(F.broadcast(total))  # one row
    return placed.where(F.col("_k") < F.greatest(share, F.lit(guarantee))).drop("_n", "_k", "_t")


def md5_shard(key: Column, shards: int) -> Column:
    """md5 of the key as a little-endian number, modulo ``shards``, folded byte by byte."""
    h = F.md5(key.cast("string"))
    out = F.lit(0).cast("bigint")
    for i in reversed(range(16)):
        byte = F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("bigint")
        out = (out * 256 + byte) % shards
    return out


def signature(df: DataFrame, ids: str, label: str) -> DataFrame:
    """md5 over the sorted md5 of rows in a tree of buckets (65,536, then 256, then one): equal tables have equal signatures, in any order."""
    rows = df.select(F.md5(F.concat_ws(":", F.col(ids).cast("string"), F.col(label).cast("string"))).alias("h"))
    digest = lambda: F.md5(F.array_join(F.sort_array(F.collect_list("h")), ""))
    leaves = rows.groupBy(F.substring("h", 1, 4).alias("b")).agg(digest().alias("h"))
    buckets = leaves.groupBy(F.substring("b", 1, 2).alias("b")).agg(digest().alias("h"))
    return buckets.agg(digest().alias("signature"))


def entropy(counts: Sequence[float]) -> float:
    total = sum(counts)
    return -sum(c / total * math.log(c / total) for c in counts if c)
