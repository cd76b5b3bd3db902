"""Chunked graph export: blocks, packed ids and edge classes as joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import materialized


@dataclass(frozen=True)
class Blocks:
    """A grid of ``shape`` blocks, x fastest, of ``size`` voxels; a voxel outside it is an error."""

    shape: tuple[int, int, int]
    size: tuple[int, int, int]

    @classmethod
    def covering(cls, extent: Sequence[int], size: tuple[int, int, int]) -> Blocks:
        """The least grid that holds a volume of ``extent`` voxels."""
        return cls(tuple(max(1, -(-n // s)) for n, s in zip(extent, size, strict=True)), size)

    @property
    def bits(self) -> int:
        """The least number of bits that holds every coordinate's range."""
        return max(1, math.ceil(math.log2(max(self.shape))))

    def of(self, x: Column, y: Column, z: Column) -> Column:
        c = [F.floor(v / s) for v, s in zip((x, y, z), self.size, strict=True)]
        inside = reduce(lambda a, b: a & b, [(v >= 0) & (v < n) for v, n in zip(c, self.shape, strict=True)])
        at = (c[0] + self.shape[0] * (c[1] + self.shape[1] * c[2])).cast("bigint")
        return F.when(inside, at).otherwise(F.raise_error(F.concat(F.lit(f"outside the grid of {self.shape} blocks: "), F.concat_ws(", ", *[v.cast("string") for v in (x, y, z)]))))

    def coords(self, block: Column) -> tuple[Column, Column, Column]:
        nx, ny, _ = self.shape
        return block % nx, F.floor(block / nx) % ny, F.floor(block / (nx * ny))

    def base(self, block: Column) -> Column:
        """Packed id of a block: layer 1 at bit 56, then the coordinates below it."""
        x, y, z = self.coords(block)
        b = self.bits
        return (F.lit(1 << 56) + x * (1 << (56 - b)) + y * (1 << (56 - 2 * b)) + z * (1 << (56 - 3 * b))).cast("bigint")


def supervoxel_ids(vox: DataFrame, blocks: Blocks, label: str = "label") -> DataFrame:
    """block, sv, rank (order of first appearance, x fastest, then of labels), pcg_id; each block is numbered by itself."""
    placed = vox.where(F.col(label) != 0).withColumn("block", blocks.of(F.col("x"), F.col("y"), F.col("z")))
    first = placed.groupBy("block", F.col(label).alias("sv")).agg(F.min(F.struct("z", "y", "x")).alias("_at"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("_at", "sv")) - 1
    return first.select("block", "sv", rank.cast("bigint").alias("rank")).withColumn("pcg_id", blocks.base(F.col("block")) + F.col("rank"))


def block_neighbours(ids: DataFrame, blocks: Blocks) -> DataFrame:
    """block, neighbour, steps: the 26 blocks around each and itself, with the number of differing coordinates."""
    own = ids.select("block").distinct()
    x, y, z = blocks.coords(F.col("block"))
    out = own.select("block", x.alias("cx"), y.alias("cy"), z.alias("cz"))
    for k, a in enumerate("xyz"):
        out = out.withColumn(f"n{a}", F.explode(F.array(*[F.col(f"c{a}") + d for d in (-1, 0, 1)]))).where((F.col(f"n{a}") >= 0) & (F.col(f"n{a}") < blocks.shape[k]))
    nx, ny, _ = blocks.shape
    steps = sum(((F.col(f"n{a}") != F.col(f"c{a}")).cast("int") for a in "xyz"), F.lit(0))
    return out.select("block", (F.col("nx") + nx * (F.col("ny") + ny * F.col("nz"))).cast("bigint").alias("neighbour"), steps.alias("steps"))


def normalized_edges(edges: DataFrame) -> DataFrame:
    """a < b, without loops, the greatest score of each pair."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


def block_edges(ids: DataFrame, edges: DataFrame, blocks: Blocks) -> DataFrame:
    """Edges of each block by class: block, class, id1, id2, affinity, a, b.

    in: both ends in the block, with a self edge (infinite affinity) for each
    supervoxel. cross: a supervoxel's parts in the block and a neighbour
    (infinite). between: ends in the block and a neighbour. A pair of labels is
    claimed once a block: in the block first, then by the nearest neighbour,
    then by the lowest.
    """
    both = materialized(normalized_edges(edges), "edges")
    ends = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    own = ids.select("block", F.col("sv").alias("a"), F.col("pcg_id").alias("id1"))
    near = block_neighbours(ids, blocks)
    other = ids.select(F.col("block").alias("neighbour"), F.col("sv").alias("b"), F.col("pcg_id").alias("id2"))
    reach = own.join(ends, "a").join(near, "block").join(other, ["neighbour", "b"])
    pair = [F.least("a", "b"), F.greatest("a", "b")]
    # within a block the lesser id is the first end
    inside = reach.where("steps = 0 AND a < b").withColumn("class", F.lit("in"))
    outside = reach.where("steps > 0").withColumn("class", F.lit("between"))
    order = Window.partitionBy("block", *pair).orderBy("steps", "neighbour", "a")
    claimed = inside.unionByName(outside).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    inf = F.lit(float("inf"))
    loops = own.select("block", F.lit("in").alias("class"), "id1", F.col("id1").alias("id2"), inf.alias("affinity"), "a", F.col("a").alias("b"))
    parts = own.join(near.where("steps > 0"), "block").join(other, "neighbour").where("a = b")
    cross = parts.select("block", F.lit("cross").alias("class"), "id1", "id2", inf.alias("affinity"), "a", "b")
    return claimed.select("block", "class", "id1", "id2", F.col("score").alias("affinity"), "a", "b").unionByName(loops).unionByName(cross)


def dropped_edges(edges: DataFrame, emitted: DataFrame) -> DataFrame:
    """Normalised edges that no block has."""
    seen = emitted.where("class <> 'cross'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return normalized_edges(edges).select("a", "b").join(seen, ["a", "b"], "left_anti")
