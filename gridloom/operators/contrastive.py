"""Contrastive losses and retrieval measures within batches of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.points import normalized


def batch_similarities(df: DataFrame, batch: str = "batch", idx: str = "idx", vector: str = "vector") -> DataFrame:
    """batch, i, j, s: cosines of all pairs within a batch (a batch is bounded by its caller)."""
    unit = df.select(batch, idx, normalized(F.transform(vector, lambda x: x.cast("double"))).alias("u"))
    a = unit.select(batch, F.col(idx).alias("i"), F.col("u").alias("p"))
    b = unit.select(batch, F.col(idx).alias("j"), F.col("u").alias("q"))
    dot = F.aggregate(F.zip_with("p", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, batch).where("i <> j").select(batch, "i", "j", dot.alias("s"))


def nt_xent(df: DataFrame, partner, temperature: float = 1.0, batch: str = "batch") -> DataFrame:
    """Cross entropy of each example's partner (an expression of i) among all others of its batch: batch, i, loss."""
    s = batch_similarities(df, batch).withColumn("e", F.exp(F.col("s") / temperature))
    own = F.sum(F.when(F.col("j") == partner, F.col("e")))
    return s.groupBy(batch, "i").agg((-F.log(own / F.sum("e"))).alias("loss"))


def retrieval(df: DataFrame, partner, batch: str = "batch") -> DataFrame:
    """The share of examples whose partner is the most alike, and among the five most alike, by batch."""
    w = Window.partitionBy(batch, "i").orderBy(F.col("s").desc(), "j")
    ranked = batch_similarities(df, batch).withColumn("rank", F.row_number().over(w)).where(F.col("j") == partner)
    return ranked.groupBy(batch).agg(F.avg((F.col("rank") <= 1).cast("double")).alias("top1"), F.avg((F.col("rank") <= 5).cast("double")).alias("top5"))


def negative_cosine(a, b):
    """The loss of two aligned vectors: minus their cosine."""
    dot = F.aggregate(F.zip_with(normalized(a), normalized(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return -dot
