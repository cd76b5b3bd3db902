"""Small files around a volume: label maps, object lists, JSON, and embeddings in zipped shards."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_relabel_map(spark: SparkSession, path: str) -> DataFrame:
    """label, new_id of a text file of pairs; lines that begin with # are comments."""
    return spark.read.option("comment", "#").option("ignoreLeadingWhiteSpace", "true").schema("label bigint, new_id bigint").csv(path)


def read_object_list(spark: SparkSession, path: str) -> DataFrame:
    """The different labels in a text file, several a line or one; lines that begin with # are comments."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.select(F.explode(F.split("value", r"[,\s]+")).alias("label")).where("label <> ''").select(F.col("label").cast("bigint").alias("label")).distinct()


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """One JSON document at ``path``, wherever Spark can write."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, pointer: str = "") -> Any:
    """The JSON document at ``path``, or the part of it at a pointer such as /a/0."""
    value = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).collect()))
    for part in filter(None, pointer.split("/")):
        part = part.replace("~1", "/").replace("~0", "~")
        value = value[int(part)] if isinstance(value, list) else value[part]
    return value


def md5_shard(number: int, shards: int, width: int = 8) -> int:
    """The shard of an id: the digest of its ``width`` little-endian bytes, as a whole number, modulo ``shards``."""
    return int.from_bytes(hashlib.md5(number.to_bytes(width, "little")).digest(), "big") % shards


def read_zipped_embeddings(spark: SparkSession, folder: str, ids: Sequence[int], shards: int, width: int = 8) -> DataFrame:
    """id, x, y, z, vector of a caller's list of ids, whose CSV files (node, x, y, z, values) lie in zipped shards.

    Only the shards that hold one of the ids are read, each by one task. An id
    without a file gives no rows.
    """
    schema = "id bigint, x double, y double, z double, vector array<double>"
    wanted = sorted(set(ids))
    if not wanted:
        return spark.createDataFrame([], schema)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    there = set(z.namelist())
                    rows = []
                    for i in wanted:
                        if f"{i}.csv" in there:
                            for line in z.read(f"{i}.csv").decode().splitlines():
                                f = line.split(",")
                                rows.append((i, *map(float, f[1:4]), [float(v) for v in f[4:]]))
                yield pd.DataFrame(rows, columns=["id", "x", "y", "z", "vector"])

    paths = [f"{folder}/{s}.zip" for s in sorted({md5_shard(i, shards, width) for i in wanted})]
    files = spark.read.format("binaryFile").load(paths).select("content")
    return files.repartition(len(paths)).mapInPandas(parse, schema)
