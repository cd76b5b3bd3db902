"""Quality classifier: regularised quadratic discriminant analysis."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name as _free
from gridloom.llm.common import written
from gridloom.llm.rules import text_statistics

#: Transformed document statistics, in SQL over the columns of ``text_statistics``. Small
#: constants keep short texts near the middle, where their ratios say little.
FEATURES: dict[str, str] = {
    "length": "log1p(n_words)",
    "symbols": "sqrt(n_symbols / (word_chars + 30))",
    "upper": "sqrt((n_upper + 2) / (word_chars + 30))",
    "marks": "sqrt(n_marks / (n_words + 8))",
    "word_length": "(word_chars + 40) / (n_words + 8)",
    "doubled_words": "sqrt(n_doubled / (n_words + 4))",
    "repeated_words": "sqrt(n_repeat_words / (n_words + 100))",
}


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one double column for each of FEATURES, row by row."""
    stats = text_statistics(df, id_col, text_col)
    return stats.select("doc_id", *(F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()))


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes. ``shrinkage`` of each covariance goes to the pooled diagonal."""

    names: tuple[str, ...]
    weight: np.ndarray  # rows of each class, 0 then 1
    mean: np.ndarray
    covariance: np.ndarray
    shrinkage: float = 0.1
    floor: float = 1e-4

    @cached_property
    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Inverse Cholesky factors and log determinants of the shrunken covariances."""
        pooled = np.average(self.covariance, axis=0, weights=self.weight)
        target = np.diag(np.diag(pooled) + self.floor)
        inverse, logs = [], []
        for c in self.covariance:
            low = np.linalg.cholesky((1 - self.shrinkage) * c + self.shrinkage * target)
            inverse.append(np.linalg.inv(low))
            logs.append(2 * np.log(np.diag(low)).sum())
        return np.array(inverse), np.array(logs)

    def score(self) -> Column:
        """Probability of class 1 from the Mahalanobis log-density difference."""
        if (self.weight == 0).any():  # one class is unknown: the share of the other
            return F.lit(float(self.weight[1] / self.weight.sum()) if self.weight.sum() else 0.5)
        inverse, logs = self.factors

        def density(k: int) -> Column:
            quad = F.lit(0.0)
            for i in range(len(self.names)):
                z = reduce(lambda a, b: a + b, [(F.col(self.names[j]) - float(self.mean[k][j])) * float(inverse[k][i][j]) for j in range(i + 1)])
                quad = quad + z * z
            return quad * -0.5 + float(np.log(self.weight[k]) - 0.5 * logs[k])

        gap = F.greatest(F.least(density(1) - density(0), F.lit(500.0)), F.lit(-500.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-gap))


def fit(rows: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Fits on all of ``rows`` (quality 0 or 1 and the feature columns).

    One aggregation of counts, sums and products: the driver gets two rows.
    """
    names = tuple(FEATURES)
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]
    weight, mean, cov = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows.groupBy("quality").agg(F.count("*").alias("n"), *sums).collect():
        k, n = r["quality"], r["n"]
        weight[k], mean[k] = n, [r[f"s{i}"] / n for i in range(d)]
        for i, j in pairs:
            cov[k][i, j] = cov[k][j, i] = r[f"p{i}_{j}"] / n - mean[k][i] * mean[k][j]
        cov[k] += 1e-9 * np.eye(d)
    return Discriminant(names, weight, mean, cov, shrinkage)


def _held_out(folds: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def _learnt(rows: DataFrame, labels: DataFrame, folds: int) -> Discriminant:
    truth = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    return fit(rows.where(~_held_out(folds)).join(truth, "doc_id"))


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``df``.

    The model learns from every labelled row whose crc32(id as text) is not
    divisible by ``folds``; the others are ``held_out``. Only the text decides
    a score. A null or empty text has the score of empty statistics; null ids
    are scored, not learnt from, and not held out; labels other than 0 and 1
    are ignored and an id labelled twice counts as 1 if any label says so;
    repeated rows have repeated scores; without labels of both classes the
    score is the share of class 1 (0.5 without any). An empty table gives no rows.
    """
    rows = written(features(df, id_col, text_col), "features")
    scored = rows.select("doc_id", _held_out(folds).alias("held_out"), _learnt(rows, labels, folds).score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """The rows of ``df`` that :func:`quality_scores` predicts to be of class 1, with all their columns.

    Statistics are taken once a row and written beside it, so no text is
    read twice or moved between tasks. Null ids, null and empty texts, labels
    and repeated rows count as there; each repeated row is kept or goes by
    itself. Columns may have any names; an empty table gives no rows.
    """
    whole = df.withColumn(_free(df, "row"), F.struct(*[df[c] for c in df.columns]))
    rows = written(features(whole, whole.columns[-1], text_col).withColumnRenamed("doc_id", "row"), "features")
    model = _learnt(rows.withColumn("doc_id", F.col("row").getField(id_col)).drop("row"), labels, folds)
    return rows.where(model.score() >= threshold).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
