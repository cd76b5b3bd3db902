"""Evaluation metrics as partial aggregates: every metric is one pass and mergeable."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_error(p: Column, t: Column) -> Column:
    return (p - t) * (p - t)


def absolute_error(p: Column, t: Column) -> Column:
    return F.abs(p - t)


def percentage_error(p: Column, t: Column, eps: float = 1e-8) -> Column:
    return F.abs(p - t) / F.greatest(F.abs(t), F.lit(eps))


def mean_metric(df: DataFrame, keys: Sequence[str], error: Callable[[Column, Column], Column], pred: str = "pred", target: str = "target") -> DataFrame:
    """Mean error by keys (a batch, or a batch and a step)."""
    return df.groupBy(*keys).agg(F.avg(error(F.col(pred), F.col(target))).alias("value"))


def relative_metric(df: DataFrame, keys: Sequence[str], error: Callable[[Column, Column], Column], baseline: str, pred: str = "pred", target: str = "target") -> DataFrame:
    """A model's mean error over a baseline's."""
    return df.groupBy(*keys).agg((F.avg(error(F.col(pred), F.col(target))) / F.avg(error(F.col(baseline), F.col(target)))).alias("value"))


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom)


def confusion_bool(df: DataFrame, keys: Sequence[str], pred: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, tn with precision, recall and f1 (null where undefined)."""
    c = lambda x: F.count_if(x)
    out = df.groupBy(*keys).agg(c(pred & truth).alias("tp"), c(pred & ~truth).alias("fp"), c(~pred & truth).alias("fn"), c(~pred & ~truth).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def confusion(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """truth, pred, n of every pair that occurs."""
    return df.groupBy(truth, pred).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """class, support, precision, recall, f1 (0 where undefined), from the confusion counts."""
    n = confusion(df, pred, truth)
    by_truth = n.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = n.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("predicted"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("tp_p"))
    both = by_truth.join(by_pred, "class", "full").na.fill(0)
    tp = F.greatest("tp", "tp_p")
    return both.select("class", "support", ratio(tp, F.col("predicted"), 0.0).alias("precision"), ratio(tp, F.col("support"), 0.0).alias("recall"), ratio(2 * tp, F.col("predicted") + F.col("support"), 0.0).alias("f1"))


def macro(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Accuracy and the means over classes."""
    classes = per_class(df, pred, truth).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    accuracy = df.agg(F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("accuracy"))
    return accuracy.crossJoin(classes)  # one row each


def score_curve(df: DataFrame, score: str, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts at each distinct score, best first, with running sums; ties count together.

    Without keys the scores are dealt into ranges, summed within each and
    shifted by the sums of the ranges before, so that no task orders them all.
    """
    steps = df.groupBy(*keys, score).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    if keys:
        run = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
        return steps.withColumns({"tp": F.sum("pos").over(run), "fp": F.sum("neg").over(run)})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.agg(F.percentile_approx(score, [k / n for k in range(1, n)], 1000)).first()[0] or []))
    part = sum(((F.col(score) < c).cast("int") for c in cuts), F.lit(0))
    placed = steps.withColumn("_p", part)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = placed.groupBy("_p").agg(F.sum("pos").alias("_a"), F.sum("neg").alias("_b"))
    shifts = sums.select("_p", F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_fp"))
    run = Window.partitionBy("_p").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({"tp": F.sum("pos").over(run), "fp": F.sum("neg").over(run)}).join(F.broadcast(shifts), "_p")
    return out.withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp")}).drop("_p", "_tp", "_fp")


def ranking_metrics(df: DataFrame, score: str, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision."""
    c = score_curve(df, score, truth, keys)
    above = F.col("tp") - F.col("pos") / 2
    out = c.groupBy(*keys).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("neg") * above).alias("pairs"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap")
    )
    return out.select(*keys, ratio(F.col("pairs"), F.col("p") * F.col("n")).alias("roc_auc"), ratio(F.col("ap"), F.col("p")).alias("average_precision"))


def valid_prediction_time(df: DataFrame, step: str, error: Column, limit: float) -> DataFrame:
    """The first step whose mean error exceeds ``limit``; the number of steps if none does."""
    by_step = df.groupBy(step).agg(F.avg(error).alias("e"))
    return by_step.agg(F.coalesce(F.min(F.when(F.col("e") > limit, F.col(step))), F.max(step) + 1).alias("step"))


def binned(df: DataFrame, position: Column, value: Column, bins: int) -> DataFrame:
    """Sum, count and mean in equal bins of [0, 1); empty bins have -1."""
    spark = df.sparkSession
    b = F.least(F.floor(position * bins), F.lit(bins - 1)).cast("int").alias("bin")
    found = df.select(b, value.alias("v")).groupBy("bin").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(-1.0).alias("mean"))


def summaries(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Max, min, mean, population deviation and number over repeats of a metric."""
    return df.groupBy(metric).agg(F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def ensemble(df: DataFrame, keys: Sequence[str], error: Callable[[Column, Column], Column], member: str = "member", pred: str = "pred", target: str = "target") -> DataFrame:
    """Mean and least error over ensemble members."""
    each = df.groupBy(*keys, member).agg(F.avg(error(F.col(pred), F.col(target))).alias("e"))
    return each.groupBy(*keys).agg(F.avg("e").alias("mean"), F.min("e").alias("least"))


def nonzero_weight(weight: Column) -> Column:
    """1 where a weight is above 0, else 0."""
    return (weight > 0).cast("bigint")


def vector_sums(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, k, v, n: the sum of each dimension of a group's vectors and how many there are."""
    long = df.select(group, F.posexplode(vector).alias("k", "_x"))
    return long.groupBy(group, "k").agg(F.sum(F.col("_x").cast("double")).alias("v"), F.count("*").alias("n"))


def value_range(df: DataFrame, vector: str) -> DataFrame:
    """k, low, high of each dimension over all rows."""
    return df.select(F.posexplode(vector).alias("k", "_x")).groupBy("k").agg(F.min(F.col("_x").cast("double")).alias("low"), F.max(F.col("_x").cast("double")).alias("high"))


def feature_regression(df: DataFrame, keys: list[str], predicted: str, target: str) -> DataFrame:
    """Mean squared error, cosine and lengths of predicted and target vectors, averaged over a group."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    length = lambda a: F.sqrt(dot(a, a))
    error = total(F.zip_with(predicted, target, lambda x, y: (x - y) * (x - y))) / F.size(predicted)
    return df.groupBy(*keys).agg(
        F.avg(error).alias("mse"),
        F.avg(dot(predicted, target) / (length(predicted) * length(target))).alias("cosine"),
        F.avg(length(predicted)).alias("predicted_norm"),
        F.avg(length(target)).alias("target_norm"),
    )
