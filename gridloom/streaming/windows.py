"""Structured Streaming forms of the running operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(stream: DataFrame, time: str, key: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """Mean, deviation, extremes and number by key and event-time window; events later than ``late`` are dropped by the watermark."""
    w = F.window(time, length, slide)
    out = stream.withWatermark(time, late).groupBy(w, key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "mean", "std", "min", "max", "n")


def running_confusion(stream: DataFrame, key: str, pred: str, truth: str) -> DataFrame:
    """tp, fp, fn, tn by key, updated as rows come."""
    p, t = F.col(pred), F.col(truth)
    return stream.groupBy(key).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Rows whose keys have not come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
