"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import blocks
from gridloom.llm.common import TEXTS_A_BATCH, written

#: Entries of the matrix of log probabilities: with more than 512 languages there are fewer buckets than 2^16.
ENTRIES = 1 << 25
#: Windows of one step: bounds the memory of a task, not the text.
WINDOWS = 1 << 19
_PAD = "\0\0"


def buckets_for(languages: int) -> int:
    """Bits of the hash: 16, or what ENTRIES allows, 6 at least."""
    return max(6, min(16, (ENTRIES // max(1, languages)).bit_length() - 1))


def windows(points: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of one, two and three code points at each place; ``points`` holds two more than there are places."""
    a, b, c = points[:-2], points[1:-1], points[2:]
    one = a * np.uint32(0x01000193)
    two = (one + b) * np.uint32(0x01000193) + np.uint32(1)
    three = (two + c) * np.uint32(0x01000193) + np.uint32(2)
    for h in (one, two, three):
        h = h ^ (h >> np.uint32(15))
        yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


def pieces(texts: list[str | None], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, rows, first place of each row) of runs of about ``most`` places.

    Each text has two blanks (U+0000) before and after it, so an n-gram never
    reaches into another text; a text of more than ``most`` places comes in
    overlapping parts of its own.
    """
    group, rows, size = [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.frombuffer((_PAD.join(["", *group]) + _PAD).encode("utf-32-le", "surrogatepass"), np.uint32)
        return points, np.array(rows), np.cumsum([0] + [len(t) + 2 for t in group[:-1]])

    for k, text in enumerate(texts):
        text = (text or "").lower()
        n = len(text) + 2
        if n > most:
            padded = _PAD + text + _PAD
            for lo in range(0, n, most):
                yield np.frombuffer(padded[lo : min(lo + most, n) + 2].encode("utf-32-le", "surrogatepass"), np.uint32), np.array([k]), np.zeros(1, np.int64)
            continue
        if group and size + n > most:
            yield flush()
            group, rows, size = [], [], 0
        group.append(text)
        rows.append(k)
        size += n
    if group:
        yield flush()


@dataclass(frozen=True)
class NaiveBayes:
    """``log_prior`` of each language and ``log_prob`` of each bucket (rows) in each language (columns)."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    bits: int

    def posterior(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each language (columns) for each whole text (rows)."""
        logs = np.tile(self.log_prior, (len(texts), 1))
        for points, rows, starts in pieces(texts, max(256, WINDOWS * 4 // max(4, len(self.languages)))):
            for h in windows(points, self.bits):
                logs[rows] += np.add.reduceat(self.log_prob[h], starts, axis=0)
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(axis=1, keepdims=True)


def gram_counts(rows: DataFrame, bits: int, most_languages: int = 64) -> DataFrame:
    """lang, bucket, n of the n-grams of all texts of ``rows`` (text, lang). Each task adds up in one array and sends what is not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        counts = np.zeros((0, 1 << bits), np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, k in seen.items():
                (at,) = np.nonzero(counts[k])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(counts[k][at])})

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, texts in blocks(batch.column("text")):
                if len(seen) + len(new := set(langs[lo : lo + len(texts)]) - set(seen)) > most_languages and seen:
                    yield from sent()
                    seen, counts, new = {}, counts[:0], set(langs[lo : lo + len(texts)])
                for lang in sorted(new):
                    seen[lang] = len(seen)
                counts = np.vstack([counts, np.zeros((len(new), 1 << bits), np.int64)]) if new else counts
                codes = np.array([seen[x] for x in langs[lo : lo + len(texts)]])
                flat = counts.reshape(-1)
                for points, of, starts in pieces(texts, WINDOWS):
                    base = np.repeat(codes[of] << bits, np.diff(np.append(starts, len(points) - 2)))
                    for h in windows(points, bits):
                        flat += np.bincount(base + h, minlength=len(flat))
        yield from sent()

    return rows.select("text", "lang").mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, smoothing: float = 0.5) -> NaiveBayes | None:
    """Learns from all of ``rows`` (text, lang, neither null); None without rows. The driver gets a row a language and one a bucket that occurs in it."""
    docs = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not docs:
        return None
    languages = sorted(docs)
    bits = buckets_for(len(languages))
    found = written(gram_counts(rows, bits), "grams", TEXTS_A_BATCH).toArrow()
    counts = np.zeros((1 << bits, len(languages)))
    where = {lang: k for k, lang in enumerate(languages)}
    if found.num_rows:
        column = found.column("lang").combine_chunks().dictionary_encode()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        of = np.array([where[x] for x in column.dictionary.to_pylist()])[column.indices.to_numpy()]
        counts[found.column("bucket").to_numpy(), of] = found.column("n").to_numpy()
    counts += smoothing
    prior = np.log(np.array([docs[x] for x in languages], float) / sum(docs.values()))
    return NaiveBayes(languages, prior, np.log(counts / counts.sum(axis=0)), bits)


def _held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``df``.

    Rows whose crc32(id as text) leaves ``fold`` modulo ``folds`` are held
    out; the model learns from all others with a text, an id and a language.
    A prediction sees the whole text only. A null text, one without a letter
    and any text when nothing was learnt are ``und`` with score 0; null ids
    are predicted, not learnt from, and not held out; repeated rows each
    count and have equal predictions; equally probable languages go by name;
    other columns are ignored; an empty table gives no rows. Texts are never
    shuffled: tasks send counts, and the matrix (at most 2^25 entries, or 64
    for each language) is broadcast.
    """
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"), df[lang_col].cast("string").alias("lang"))
    model = fit(rows.where(F.col("doc_id").isNotNull() & ~_held_out(folds, fold) & F.col("text").isNotNull() & F.col("lang").isNotNull()))
    shown = rows.select("doc_id", _held_out(folds, fold).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if model is None:
        return shown.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lo, texts in blocks(batch.column("text")):
                p = known.posterior(texts)
                best = p.argmax(axis=1)
                none = [t is None for t in texts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(lo, len(texts)),
                        "held_out": batch.column("held_out").slice(lo, len(texts)),
                        "lang_pred": pa.array(["und" if x else known.languages[k] for x, k in zip(none, best, strict=True)]),
                        "score": pa.array(np.where(none, 0.0, p[np.arange(len(p)), best])),
                    }
                )

    kind = df.schema[id_col].dataType.simpleString()
    return written(shown.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"), "languages", TEXTS_A_BATCH)
