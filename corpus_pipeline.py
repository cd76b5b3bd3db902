"""A corpus pipeline of five stages, each one of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.classifier import keep_good
from gridloom.llm.common import table
from gridloom.llm.jaccard import keep_one
from gridloom.llm.lines import apply_line_marks, line_marks
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import redact_rows
from gridloom.sources.shared import shared_path


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It is fitted on all labelled rows outside the held-out fold. Null and empty
    texts are scored like others, null ids and repeated rows are kept or go row
    by row; without labels of both classes every row has the share of class 1
    as its score. Extra columns stay; an empty table stays empty.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document may end up empty and stays.

    "Earlier" is the smallest doc_id, so ties cannot arise. Null ids neither
    lose lines nor hold them; rows that repeat an id are one document; a null
    text becomes empty. Extra columns stay; an empty table stays empty.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = apply_line_marks(docs, line_marks(docs), carry=rest)
    named = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(f"carried.{c}") for c in rest}
    return _counted(kept.select(*[named[c].alias(c) for c in docs.columns]))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id.

    Rows with a null id, and texts without words, all stay; texts under one id
    are told apart; of equal rows of a group one stays. Extra columns stay;
    an empty table stays empty.
    """
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; ``n_chars`` is counted anew.

    A null text becomes empty; null ids and repeated rows stay as they are;
    extra columns stay; an empty table stays empty.
    """
    return _counted(redact_rows(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences.

    A null or empty text is the closing id alone; null ids pass through;
    repeated rows are packed each; pieces of equal length are interchangeable;
    an empty table gives no pieces.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot express the classifier or the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
