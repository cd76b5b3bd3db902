"""Chunk tables: volumes on storage, range reads, writes that resume."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class VolumeMetadata:
    """What is known of a volume besides its voxels."""

    path: str
    size: tuple[int, int, int]
    voxel_nm: tuple[float, float, float]
    chunk: tuple[int, int, int]
    channels: int = 1
    dtype: str = "uint8"
    boxes: tuple = field(default=())

    def scaled(self, factor: Sequence[float]) -> VolumeMetadata:
        """Size and voxel size of the volume resampled by ``factor``; channels and type stay."""
        size = tuple(int(n * f) for n, f in zip(self.size, factor, strict=True))
        voxel = tuple(v / f for v, f in zip(self.voxel_nm, factor, strict=True))
        return VolumeMetadata(**{**asdict(self), "size": size, "voxel_nm": voxel})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> VolumeMetadata:
        raw = json.loads(text)
        return VolumeMetadata(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def to_chunks(df: DataFrame, chunk: Sequence[int], value: str = "v") -> DataFrame:
    """Voxel table -> cx, cy, cz, voxels (sorted array of place and value)."""
    keys = [F.floor(F.col(a) / c).alias(f"c{a}") for a, c in zip(AXES, chunk, strict=True)]
    place = F.struct(*[F.pmod(F.col(a), F.lit(c)).cast("int").alias(a) for a, c in zip(reversed(AXES), reversed(chunk), strict=True)], F.col(value).alias("v"))
    return df.select(*keys, place.alias("p")).groupBy("cx", "cy", "cz").agg(F.sort_array(F.collect_list("p")).alias("voxels"))


def from_chunks(chunks: DataFrame, chunk: Sequence[int], value: str = "v") -> DataFrame:
    out = chunks.select("cx", "cy", "cz", F.explode("voxels").alias("p"))
    return out.select(*[(F.col(f"c{a}").cast("bigint") * c + F.col(f"p.{a}")).alias(a) for a, c in zip(AXES, chunk, strict=True)], F.col("p.v").alias(value))


def read_range(chunks: DataFrame, chunk: Sequence[int], start: Sequence[int], end: Sequence[int]) -> DataFrame:
    """Voxels of a half-open box: chunk coordinates are compared first, so that the scan prunes by them."""
    for a, c, lo, hi in zip(AXES, chunk, start, end, strict=True):
        chunks = chunks.where((F.col(f"c{a}") >= lo // c) & (F.col(f"c{a}") <= (hi - 1) // c))
    out = from_chunks(chunks, chunk)
    for a, lo, hi in zip(AXES, start, end, strict=True):
        out = out.where((F.col(a) >= lo) & (F.col(a) < hi))
    return out


def write_chunks(chunks: DataFrame, path: str, resume: bool = False) -> None:
    """Writes a chunk table in ranges of (cz, cy, cx), so that readers skip files and row groups by their bounds; with ``resume`` only chunks that are not there yet.

    There is no folder a cz: their number would grow with the volume, and that of files with its square.
    """
    spark = chunks.sparkSession
    if resume:
        try:
            there = spark.read.parquet(path).select("cx", "cy", "cz")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            chunks = chunks.join(there, ["cx", "cy", "cz"], "left_anti")
    order = ["cz", "cy", "cx"]
    chunks.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append" if resume else "overwrite").parquet(path)


def read_equivalences(spark: SparkSession, path: str) -> DataFrame:
    """a, b pairs of a CSV file."""
    return spark.read.schema("a bigint, b bigint").csv(path)
