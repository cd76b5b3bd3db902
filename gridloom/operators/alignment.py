"""Alignment of two sets of embeddings through shared anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import materialized


def unit(v: Column) -> Column:
    """An array divided by its length."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / norm)


def standardized_units(df: DataFrame, vector: str, like: DataFrame | None = None) -> DataFrame:
    """``vector`` with each dimension's mean and deviation (population, over ``like`` or itself) taken out, at length one.

    The statistics are one row, of as many numbers as a vector has dimensions.
    """
    long = (df if like is None else like).select(F.posexplode(vector).alias("_k", "_x")).groupBy("_k").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    stats = long.agg(F.sort_array(F.collect_list(F.struct("_k", "_m", "_s"))).alias("_stats"))
    scaled = F.transform(vector, lambda x, i: (x - F.get("_stats", i)["_m"]) / F.get("_stats", i)["_s"])
    return df.crossJoin(F.broadcast(stats)).withColumn(vector, scaled).withColumn(vector, unit(F.col(vector))).drop("_stats")  # one row


def distances_to_anchors(df: DataFrame, anchors: DataFrame, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """id, anchor, d: Euclidean distances to each of the caller's anchors (anchor, vector), which are broadcast."""
    far = F.sqrt(F.aggregate(F.zip_with(vector, "_a", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    return df.select(F.col(id_col).alias("id"), vector).crossJoin(F.broadcast(anchors.select("anchor", F.col(vector).alias("_a")))).select("id", "anchor", far.alias("d"))


def sharpened(relative: DataFrame, exponent: float) -> DataFrame:
    """id, anchor, e: distances standardised over all rows of an anchor, with their absolute value raised to ``exponent`` and their sign kept."""
    stats = relative.groupBy("anchor").agg(F.avg("d").alias("_m"), F.stddev_pop("d").alias("_s"))
    z = (F.col("d") - F.col("_m")) / F.col("_s")
    return relative.join(F.broadcast(stats), "anchor").select("id", "anchor", (F.signum(z) * F.pow(F.abs(z), exponent)).alias("e"))


def _vectors(encoded: DataFrame) -> DataFrame:
    """id, vector of encodings (id, anchor, e), by anchor, at length one."""
    rows = encoded.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("anchor", "e"))).alias("_l"))
    return rows.select("id", unit(F.transform("_l", lambda s: s["e"])).alias("vector"))


#: Rows of the caller's side that go to all tasks at once.
BLOCK = 10_000
#: Pairs of rows that a task makes at once.
PAIRS = 1 << 17


def blocks_of(df: DataFrame, key: str, most: int = BLOCK) -> Iterator[DataFrame]:
    """``df`` in blocks of about ``most`` rows by a hash of ``key``, however many rows it has."""
    n = -(-df.count() // most)
    for k in range(n):
        yield df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)


def cross_distance(first: DataFrame, second: DataFrame) -> DataFrame:
    """a, b, cosine distance of sharpened encodings (id, anchor, e) of the rows of ``first`` and a caller's ``second``.

    Each side becomes one vector a row; those of ``second`` go to all tasks of
    ``first`` in counted blocks, so no anchor gathers the rows of both, and
    pairs leave a task in batches of ``PAIRS``. All ids must have the same anchors.
    """
    left, right, out = materialized(_vectors(first), "first"), materialized(_vectors(second), "second"), None
    kinds = f"a {left.schema['id'].dataType.simpleString()}, b {right.schema['id'].dataType.simpleString()}, distance double"
    for block in blocks_of(right, "id"):
        rows = block.toArrow()
        ids, m = rows.column("id").combine_chunks(), np.array(rows.column("vector").to_pylist())

        def run(batches: Iterator[pa.RecordBatch], ids=ids, m=m) -> Iterator[pa.RecordBatch]:
            step = max(PAIRS // len(m), 1)
            for batch in batches:
                for first in range(0, batch.num_rows, step):
                    part = batch.slice(first, step)
                    x = np.array(part.column("vector").to_pylist())
                    near = 1 - x @ m.T
                    yield pa.RecordBatch.from_pydict({"a": part.column("id").take(pa.array(np.repeat(np.arange(len(x)), len(m)))), "b": ids.take(pa.array(np.tile(np.arange(len(m)), len(x)))), "distance": pa.array(near.ravel())})

        found = left.mapInArrow(run, kinds)
        out = found if out is None else out.unionByName(found)
    return first.sparkSession.createDataFrame([], kinds) if out is None else out


def backprojected(relative: DataFrame, anchors: DataFrame, exponent: float = 4.0, vector: str = "vector") -> DataFrame:
    """id, k, v: the weighted mean of the anchors' vectors by dimension.

    Weights are 1 / distance ^ ``exponent``; those below half of a row's largest
    are left out.
    """
    w = Window.partitionBy("id")
    weights = relative.withColumn("_w", 1 / F.pow("d", F.lit(exponent)))
    weights = weights.withColumn("_w", F.when(F.col("_w") >= F.max("_w").over(w) / 2, F.col("_w"))).where("_w IS NOT NULL")
    long = anchors.select("anchor", F.posexplode(vector).alias("k", "_x"))
    return weights.join(F.broadcast(long), "anchor").groupBy("id", "k").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("v"))


def product_matrix(df: DataFrame, vector: str) -> DataFrame:
    """i, j, c: the correlation (population; null without variance) of the dimensions of ``vector`` over all rows.

    Tasks add up products about their own means, a row for two dimensions
    each, and the means are brought together afterwards. Null vectors and those
    with a null or of another length than the longest are left out.
    """
    rows = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, about = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            if len(x):
                own = x.mean(axis=0)
                about += (x - own).T @ (x - own) + n * len(x) / (n + len(x)) * np.outer(own - mean, own - mean)
                mean = mean + (own - mean) * len(x) / (n + len(x))
                n += len(x)
        if n:
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(np.full(d * d, n)), "mi": pa.array(mean[i]), "mj": pa.array(mean[j]), "p": pa.array(about.ravel())})

    parts = materialized(rows.where(F.size("v") == d).mapInArrow(run, "i int, j int, n bigint, mi double, mj double, p double"), "products")
    means = parts.where("i = j").groupBy(F.col("i").alias("k")).agg((F.sum(F.col("n") * F.col("mi")) / F.sum("n")).alias("m"))
    mean = lambda c: F.broadcast(means.select(F.col("k").alias(c), F.col("m").alias(f"_{c}")))  # noqa: E731  a row a dimension
    whole = parts.join(mean("i"), "i").join(mean("j"), "j").groupBy("i", "j").agg(F.sum(F.col("p") + F.col("n") * (F.col("mi") - F.col("_i")) * (F.col("mj") - F.col("_j"))).alias("p"))
    own = materialized(whole, "whole")
    var = lambda c: F.broadcast(own.where("i = j").select(F.col("i").alias(c), F.col("p").alias(f"_{c}")))
    return own.join(var("i"), "i").join(var("j"), "j").select("i", "j", F.when((F.col("_i") > 0) & (F.col("_j") > 0), F.col("p") / F.sqrt(F.col("_i") * F.col("_j"))).alias("c"))
