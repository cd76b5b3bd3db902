"""Voxel-wise operators: projections over a voxel table, without a shuffle unless two volumes meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The range that values of a type span when they are rescaled (fixed values).
RANGES = {"bool": (0.0, 1.0), "uint8": (0.0, 255.0), "int16": (0.0, 32767.0), "uint16": (0.0, 65535.0), "float": (0.0, 1.0)}
_SQL = {"bool": "boolean", "uint8": "smallint", "int16": "smallint", "uint16": "int", "float": "double"}


def cast_rescale(c: Column, source: str, target: str, rescale: bool = True) -> Column:
    """Converts between value types; with ``rescale`` the source range maps onto the target's."""
    if source not in RANGES or target not in RANGES:
        raise TypeError(f"cannot convert {source} to {target}")
    value = c.cast("double")
    if rescale:
        value = value / RANGES[source][1] * RANGES[target][1]
    if target == "bool":
        return value >= 0.5 if rescale else value != 0
    if target == "float":
        return value
    low, high = RANGES[target]
    return F.least(F.greatest(F.round(value) if rescale else F.floor(value), F.lit(low)), F.lit(high)).cast(_SQL[target])


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clips to [low, high]; None leaves an end open, NaN stays NaN."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(F.isnan(c), c).otherwise(out)


def threshold(c: Column, t: float) -> Column:
    """1 above ``t``, else 0."""
    return F.when(c > t, 1.0).otherwise(0.0)


def standardize(c: Column, mean: float, std: float) -> Column:
    return (c - mean) / std


def rescale(c: Column, low_in: float, high_in: float, low_out: float, high_out: float) -> Column:
    """Maps [low_in, high_in] onto [low_out, high_out]."""
    return (c - low_in) / (high_in - low_in) * (high_out - low_out) + low_out


def nan_replace(c: Column, fill: float) -> Column:
    return F.when(F.isnan(c), F.lit(fill)).otherwise(c)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where a zero denominator counts as 1."""
    return top / F.when(bottom == 0, F.lit(1.0)).otherwise(bottom)


def multiply_pointwise(a: DataFrame, b: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Product of two aligned volumes."""
    return a.join(b.select(*keys, F.col(value).alias("_w")), keys).withColumn(value, F.col(value) * F.col("_w")).drop("_w")


def delta_f_over_f(f: DataFrame, f0: DataFrame, keys: list[str], baseline: float, value: str = "v") -> DataFrame:
    """(f - f0) / (f0 - baseline), a zero denominator counting as 1."""
    both = f.join(f0.select(*keys, F.col(value).alias("_f0")), keys)
    return both.withColumn(value, safe_ratio(F.col(value) - F.col("_f0"), F.col("_f0") - baseline)).drop("_f0")


def delta_f_by_percentile(f: DataFrame, p: DataFrame, keys: list[str], smooth: float, value: str = "v") -> DataFrame:
    """(f - p) / (smooth + p), a zero denominator counting as 1."""
    both = f.join(p.select(*keys, F.col(value).alias("_p")), keys)
    return both.withColumn(value, safe_ratio(F.col(value) - F.col("_p"), F.col("_p") + smooth)).drop("_p")


def dempster_shafer(logits: Column) -> Column:
    """K / (K + sum of exp(logit))."""
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double")))
    return F.size(logits) / (F.size(logits) + total)


def adjusted_logits(logits: Column, variance: float, scale: float) -> Column:
    """Softmax of logits divided by sqrt(1 + scale * variance)."""
    e = F.transform(logits, lambda x: F.exp(x.cast("double") / (1 + scale * variance) ** 0.5))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def cosine_ramp(t: Column, exponent: float = 1.0, skew: float = 1.0) -> Column:
    """1 - |cos(pi/2 * t^skew)|^exponent falling from 1 to 0 as 1 - it."""
    return F.pow(F.abs(F.cos(F.pow(t, F.lit(skew)) * 1.5707963267948966)), F.lit(exponent))


def linear_log_snr(t: Column, low: float = -20.0, high: float = 20.0) -> Column:
    """Sigmoid of a log signal-to-noise ratio that falls linearly from ``high`` to ``low``."""
    return 1 / (1 + F.exp(-(F.lit(high) + (low - high) * t)))


def clip_outliers_in_array(values: Column, low: float, high: float) -> Column:
    return F.transform(values, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def pad_array(values: Column, before: int, after: int, fill: float) -> Column:
    return F.concat(F.array_repeat(F.lit(fill), before), values, F.array_repeat(F.lit(fill), after))


def reshape_array(values: Column, width: int) -> Column:
    """Rows of ``width`` values; the number of values must be a multiple."""
    return F.transform(F.sequence(F.lit(0), (F.size(values) / width).cast("int") - 1), lambda i: F.slice(values, i * width + 1, F.lit(width)))


def transpose_array(rows: Column) -> Column:
    """Swaps the axes of an array of equally long arrays."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def schedule(t: Column, name: str) -> Column:
    """A schedule by name: linear, cosine (cosine_power, cosine_power_exponent), or linear_logsnr (linear_logsnr_low_high)."""
    kind, *numbers = name.replace("linear_logsnr", "logsnr").split("_")
    args = list(map(float, numbers))
    if kind == "linear" and not args:
        return t
    if kind == "cosine" and len(args) < 3:
        return cosine_ramp(t, *args, *(1.0, 1.0)[len(args) :])
    if kind == "logsnr" and len(args) in (0, 2):
        return linear_log_snr(t, *args)
    raise ValueError(f"no schedule named {name!r}")


def combine_map(point: Column, samples: int, points: int) -> Column:
    """The sample that a point of ``samples`` concatenated ones came from; ``points`` must be a multiple of them."""
    if points % samples:
        raise ValueError(f"{points} points are no multiple of {samples} samples")
    return F.floor(point / (points // samples))
