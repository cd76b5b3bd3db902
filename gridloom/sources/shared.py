"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A written table of more rows is no broadcast side of a join: Spark judges by the size of its files, which may be small for very many rows.
BROADCAST_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of this process's own where it is unset and everything runs in it (tests).

    On a cluster an unset folder is an error: each machine would write to its
    own disk. Tables written there stay until the folder is cleaned.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as parquet and reads it back: iterative plans stay short and survive lost executors.

    A table of more than ``BROADCAST_ROWS`` rows meets others in sort-merge
    joins, whatever its files' size, so it never passes the driver whole.
    """
    path = shared_path(df.sparkSession, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.hint("merge") if (seen.get.get("rows") or 0) > BROADCAST_ROWS else back
