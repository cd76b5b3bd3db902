"""Augmentations whose random numbers follow from a key and a seed, so that any engine repeats them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.tours import numbered


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest of ``seed`` and ``key``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def shifted(df: DataFrame, key: str, most: Sequence[int], seed: str = "shift", axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Each coordinate moved by a whole number in -most..most, alike for all rows of a key."""
    for a, m in zip(axes, most, strict=True):
        df = df.withColumn(a, F.col(a) + F.floor(uniform(F.col(key), f"{seed}{a}") * (2 * m + 1)) - m)
    return df


def gray(df: DataFrame, key: str, value: str = "v", scale: tuple[float, float] = (0.8, 1.2), offset: tuple[float, float] = (-0.1, 0.1), gamma: tuple[float, float] = (0.7, 1.4), seed: str = "gray") -> DataFrame:
    """clip(v * a + b, 0, 1) ^ c with a, b and c drawn for each key."""
    draw = lambda name, lo_hi: uniform(F.col(key), f"{seed}{name}") * (lo_hi[1] - lo_hi[0]) + lo_hi[0]
    c = F.greatest(F.least(F.col(value) * draw("a", scale) + draw("b", offset), F.lit(1.0)), F.lit(0.0))
    return df.withColumn(value, F.pow(c, draw("c", gamma)))


def flipped(df: DataFrame, key: str, shape: Sequence[int], seed: str = "flip", axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Each axis of a key's block reversed or not."""
    for a, n in zip(axes, shape, strict=True):
        df = df.withColumn(a, F.when(uniform(F.col(key), f"{seed}{a}") < 0.5, n - 1 - F.col(a)).otherwise(F.col(a)))
    return df


def permuted(df: DataFrame, key: str, seed: str = "permute", axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The axes of a key's block in another order."""
    drawn = F.sort_array(F.array(*[F.struct(uniform(F.col(key), f"{seed}{a}").alias("u"), F.col(a).alias("at")) for a in axes]))
    return df.withColumn("_o", drawn).withColumns({a: F.get("_o", F.lit(k))["at"] for k, a in enumerate(axes)}).drop("_o")


def subset(df: DataFrame, key: str, n: int, seed: str = "subset", within: Sequence[str] = ()) -> DataFrame:
    """``n`` rows without replacement, of each group ``within`` if named: those of the least draws, ties by key.

    Of the whole table they are found by a sort that keeps ``n`` rows a task.
    """
    drawn = df.withColumn("_u", uniform(F.col(key), seed))
    if not within:
        return drawn.orderBy("_u", key).limit(n).drop("_u")
    w = Window.partitionBy(*within).orderBy("_u", key)
    return drawn.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_u", "_k")


def key_channels(v: Column, mask: Column, kinds: Sequence[str]) -> Column:
    """The channels of a sample, in the order of ``kinds``: em, seg, or em within the mask."""
    known = {"em": v.cast("float"), "seg": mask.cast("float"), "masked_em": F.when(mask.cast("boolean"), v).otherwise(0.0).cast("float")}
    if missing := [k for k in kinds if k not in known]:
        raise ValueError(f"no channels named {missing}")
    return F.array(*[known[k] for k in kinds])


def padded_batches(df: DataFrame, order: str, size: int, value: str = "v", fill: float = 0.0) -> DataFrame:
    """batch, place, value: rows numbered from 0 in ``order`` (nulls first, equal ones by value), ``size`` a batch, the last one filled up.

    Numbers come from sorted ranges, so gaps, repeats and hot values of
    ``order`` matter neither to the batches nor to the work. An empty table
    has no batches.
    """
    rows = numbered(df.select(F.col(order).alias("_o"), F.col(value).alias("_v")), "_o", "_v")
    batches = rows.groupBy(F.floor(F.col("n") / size).alias("batch")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("n") % size).cast("int"), "_v"))).alias("_m"))
    places = batches.select("batch", "_m", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("place"))
    return places.select("batch", "place", F.when(F.map_contains_key("_m", F.col("place")), F.try_element_at("_m", "place")).otherwise(F.lit(fill)).alias(value))
