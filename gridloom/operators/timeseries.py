"""Operators over ordered series: windows that slide at the edges, percentiles, evoked responses, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped_window(t: Column, radius: int, n: Column) -> tuple[Column, Column]:
    """[start, end) of 2 radius + 1 steps around ``t``; at the edges the window slides and does not shrink, in short series it is all of them."""
    w = 2 * radius + 1
    start = F.when(t < radius, 0).when(t + radius >= n - 1, F.greatest(n - w, F.lit(0))).otherwise(t - radius)
    end = F.when(t < radius, F.least(n, F.lit(w))).when(t + radius >= n - 1, n).otherwise(t + radius + 1)
    return start.cast("bigint"), end.cast("bigint")


def clamped_percentiles(df: DataFrame, keys: Sequence[str], radius: int, qs: Sequence[float], t: str = "t", value: str = "v") -> DataFrame:
    """Nearest-rank percentiles (ranks round half to even) in the clamped window at every step: keys, t, q, value.

    One sort of each series: a frame of 4 radius + 1 rows holds every window,
    which is cut out of it by its place.
    """
    order = Window.partitionBy(*keys).orderBy(t)
    near = F.collect_list(value).over(order.rowsBetween(-2 * radius, 2 * radius))
    whole = Window.partitionBy(*keys)
    rows = df.select(*keys, t, F.count("*").over(whole).alias("_n"), near.alias("_near"))
    start, end = clamped_window(F.col(t), radius, F.col("_n"))
    first = F.greatest(F.col(t) - 2 * radius, F.lit(0))
    rows = rows.select(*keys, t, F.sort_array(F.slice("_near", (start - first + 1).cast("int"), (end - start).cast("int"))).alias("_s"))
    at = lambda q: F.get("_s", F.rint(F.lit(q) * (F.size("_s") - 1)).cast("int"))
    picks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), at(q).alias("v")) for q in qs]))
    return rows.withColumn("_p", picks).select(*keys, t, F.col("_p.q").alias("q"), F.col("_p.v").alias(value))


def moving(df: DataFrame, keys: Sequence[str], radius: int, agg: Column, name: str, t: str = "t") -> DataFrame:
    """An aggregate over the 2 radius + 1 nearest steps, fewer at the edges."""
    return df.withColumn(name, agg.over(Window.partitionBy(*keys).orderBy(t).rowsBetween(-radius, radius)))


def evoked_response(
    df: DataFrame, keys: Sequence[str], periods: Sequence[int], align: str = "right", exclusive_max: int | None = None, subtract: bool = True, t: str = "t", value: str = "v"
) -> DataFrame:
    """The average response at each phase of repeated periods of the given lengths.

    ``align`` says which side of shorter periods is filled up ("left" aligns
    ends, "right" aligns starts). Only the repeats before ``exclusive_max``
    (negative: without the last ones) make the average. With ``subtract`` the
    average leaves the series, else it replaces it. Without periods the
    series' mean does. Steps beyond the periods are left out.
    """
    if not periods:
        mean = F.avg(value).over(Window.partitionBy(*keys))
        return df.withColumn(value, F.col(value) - mean if subtract else mean)
    spark, longest, start, rows = df.sparkSession, max(periods), 0, []
    for k, n in enumerate(periods):
        rows += [(start + i, i + (longest - n if align == "left" else 0), k in range(len(periods))[:exclusive_max]) for i in range(n)]
        start += n
    phases = F.broadcast(spark.createDataFrame(rows, f"{t} bigint, _phase int, _used boolean"))  # one row a step of the caller's periods
    placed = df.join(phases, t)
    mean = F.avg(F.when(F.col("_used"), F.col(value))).over(Window.partitionBy(*keys, "_phase"))
    return placed.withColumn("phase", F.col("_phase")).withColumn(value, F.col(value) - mean if subtract else mean).drop("_phase", "_used")


def correlate_with(df: DataFrame, key: str, reference: DataFrame, t: str = "t", value: str = "v") -> DataFrame:
    """Pearson correlation of every series with one reference series (t, value)."""
    ref = reference.select(t, F.col(value).alias("_r"))
    return df.join(ref, t).groupBy(key).agg(F.corr(value, "_r").alias("r"))


def to_series(df: DataFrame, keys: Sequence[str], t: str = "t", value: str = "v") -> DataFrame:
    """Long table -> one array a series, in order of time."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(t, value))).alias("_s")).select(*keys, F.transform("_s", lambda s: s[value]).alias(value))


def to_frames(df: DataFrame, keys: Sequence[str], t: str = "t", value: str = "v") -> DataFrame:
    """Series of arrays -> the long table again."""
    return df.select(*keys, F.posexplode(value).alias(t, value)).withColumn(t, F.col(t).cast("bigint"))


def correlate_with_center(df: DataFrame, series: str) -> DataFrame:
    """Correlation of every series with the one in the middle of the range of keys (rounded up)."""
    low, high = df.agg(F.min(series), F.max(series)).first()
    middle = None if low is None else (low + high + 1) // 2
    return correlate_with(df, series, df.where(F.col(series) == F.lit(middle)))
