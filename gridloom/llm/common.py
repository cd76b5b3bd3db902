"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.shared import shared_path

#: The white space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch where whole texts go to Python: a few megabytes, and not the tens that 10,000 texts take.
TEXTS_A_BATCH = 1000


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a reader of it; while it is written, Arrow batches hold at most ``batch`` rows.

    Cuts the lineage: a lost executor costs at most the tasks that read the
    files, never the work that made them.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = shared_path(spark, name)
    before = spark.conf.get(key)
    if batch is not None and not 0 < int(before) <= batch:
        spark.conf.set(key, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    A lambda that names an outer expression would compute it for every
    element; binding it as the variable of an enclosing lambda does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Plain ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def _running(values: Column, joined) -> Column:
    """Inclusive running results of an array<bigint> in O(m log m), by doubling; ``joined(later, earlier)``, where earlier may be null."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(values))
    return F.aggregate(steps, values, lambda acc, p: F.transform(acc, lambda v, i: joined(v, F.when(i >= p, F.get(acc, i - p)))))


def prefix_sums(values: Column) -> Column:
    return _running(values, lambda v, before: v + F.coalesce(before, F.lit(0).cast("bigint")))


def prefix_max(values: Column) -> Column:
    return _running(values.cast("array<bigint>"), lambda v, before: F.greatest(v, before))
