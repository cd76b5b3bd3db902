"""Embedding whitening: principal components by spectral divide-and-conquer over polar decompositions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written

EPS = np.finfo(float).eps
#: Entries beyond this are treated like those that are not finite: their scaled integers leave no room for exact sums.
LARGEST = 2.0**40


def polar_factor(a: np.ndarray, most: int = 40) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps in their QR form.

    ``low`` bounds the least singular value of the iterate from below and
    sets each step's weights; six or seven steps do even for a condition of
    1e16.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a, 1), np.finfo(float).tiny)
    low = 1e-17
    inverse_norm = np.linalg.norm(np.linalg.pinv(x, rcond=1e-16), 2)
    if np.isfinite(inverse_norm) and inverse_norm > 0:
        low = min(max(low, 0.9 / inverse_norm), 1.0)
    for _ in range(most):
        square = low * low
        root = np.sqrt(1 + np.cbrt(4 * (1 - square) / square**2))
        a_ = root + np.sqrt(max(0.0, 8 - 4 * (root * root - 1) + 8 * (2 - square) / (square * root))) / 2
        b = (a_ - 1) ** 2 / 4
        c = a_ + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        new = (b / c) * x + ((a_ - b / c) / np.sqrt(c)) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        step, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (a_ + b * square) / (1 + c * square))
        if step < EPS ** (1 / 3) and 1 - low < 1e-12:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the eigenvectors above ``shift``, and how many; None where the shift does not divide."""
    n = len(a)
    above = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(above)))
    if not 0 < k < n:
        return None
    q = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))[0]
    for _ in range(3):  # the projector acts on a full basis: two rounds of subspace iteration and one against rounding
        q, _ = np.linalg.qr(np.hstack([above @ q[:, :k], q[:, k:] - above @ q[:, k:]]))
    left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
    return (q, k) if left <= 100 * n * EPS * np.linalg.norm(a) else None


def _descend(a: np.ndarray, wanted: int, floor: float) -> np.ndarray:
    """Basis of ``a`` in which it is diagonal, for its ``wanted`` largest eigenvalues at least."""
    n = len(a)
    mean = np.trace(a) / n
    if n == 1 or np.linalg.norm(a - mean * np.eye(n)) <= floor:
        return np.eye(n)
    # The mean lies strictly between the extremes; no more than n of the others can be eigenvalues.
    spread = np.linalg.norm(a - mean * np.eye(n)) / n
    for shift in [float(np.median(np.diag(a))), mean, *(mean + spread * s * t / (n + 1) for t in range(1, n + 2) for s in (1, -1))]:
        if (found := _split(a, shift)) is not None:
            break
    else:
        return np.eye(n)  # rounding is as large as what is left to divide
    q, k = found
    parts = [(q[:, :k], min(wanted, k)), (q[:, k:], wanted - k)]
    out = []
    for basis, need in parts:
        inner = basis.T @ a @ basis
        out.append(basis @ _descend((inner + inner.T) / 2, need, floor) if need > 0 else basis)
    return np.hstack(out)


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix: the ``most`` largest of those above 1e-10 of the largest.

    Polar decompositions of the shifted matrix give the spectral projector of
    the eigenvalues above the shift; its range and the rest are divided again
    until each part is a multiple of the identity. Parts that hold none of
    the wanted eigenvalues are left undivided.
    """
    a = (covariance + covariance.T) / 2
    if not len(a) or np.linalg.norm(a) == 0:
        return np.zeros(0), np.zeros((len(a), 0))
    q = _descend(a, min(most, len(a)), 4 * EPS * np.linalg.norm(a))
    values = np.einsum("ij,ij->j", q, a @ q)
    order = np.argsort(-values[: len(a)], kind="stable")[:most]
    values, q = values[order], q[:, order]
    keep = values > 1e-10 * values[0] if len(values) and values[0] > 0 else np.zeros(len(values), bool)
    return values[keep], q[:, keep]


@dataclass(frozen=True)
class Whitening:
    """Statistics of the fitted rows and the map that whitens them."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _spread(x, self.n, self.sums).astype(float) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def _spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S exactly: 64-bit integers where they suffice, else Python's."""
    largest = max(map(abs, sums), default=0)
    if len(x) and int(np.abs(x).max()) * n + largest >= 2**62:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, dtype=np.int64 if largest < 2**62 else object)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Row sums of (n*x - S)^2, exactly; None where they exceed a long."""
    d = _spread(x, n, sums)
    if d.dtype != object and (not d.size or (float(np.abs(d).max()) ** 2) * d.shape[1] < 2.0**62):
        return (d * d).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in (sum(int(v) ** 2 for v in row) for row in d.tolist())]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(np.int64)


def scaled_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x array<bigint>: floor(1024 c) + 100000 of each entry of the usable rows."""
    good = F.forall(df[vector_col], lambda v: F.coalesce(F.abs(v.cast("double")) <= LARGEST, F.lit(False)))  # NaN is greater than any number
    x = F.transform(df[vector_col], lambda v: F.floor(v.cast("double") * 1024.0).cast("bigint") + F.lit(100000).cast("bigint"))
    return df.where(df[vector_col].isNotNull() & good).select(df[id_col].alias("vec_id"), x.alias("x"))


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, sums by dimension), exactly: a row a dimension from each task, added in decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch)
            n += len(x)
            small = not len(x) or int(np.abs(x).max()) * len(x) < 2**62
            total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array(list(map(str, total)))})

    found = rows.select("x").mapInArrow(run, "i int, n bigint, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def _products(rows: DataFrame, transform, d: int, n: int) -> np.ndarray:
    """Mean products of the columns of ``transform(x)``: each task adds its rows up, Spark adds the tasks."""
    ij = np.tril_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = transform(_matrix(batch))
            total += y.T @ y
        for lo in range(0, len(ij[0]), 1 << 16):
            i, j = ij[0][lo : lo + (1 << 16)], ij[1][lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    out = np.zeros((d, d))
    for r in rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def fit(rows: DataFrame, d: int, most: int = 8) -> Whitening:
    """Fits on all of ``rows`` (x of length ``d``); the driver gets sums by dimension and pair of dimensions only."""
    n, sums = _sums(rows, d)
    plain = Whitening(n, sums, np.ones(d), np.eye(d), 0.0)
    covariance = _products(rows, plain.centred, d, n)
    values, vectors = components(covariance, most)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Rows whose vector is null, holds a null or an entry that is not finite (or
    beyond 2^40) are dropped; so are vectors of another length than the most
    frequent one (the longer of equally frequent ones). The others are the
    fit list and all of them are whitened. Components without variance (under
    1e-10 of the largest) are left out, so equal rows, a single row or an
    empty table give no rows. Null ids pass through, repeated rows each count;
    ``deviation`` is null beyond a long; other columns are ignored. Rows are
    never shuffled: tasks send sums by dimension, the driver divides one
    matrix of d x d, and the map goes to the tasks with their code.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = written(scaled_vectors(df, id_col, vector_col), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return df.sparkSession.createDataFrame([], shape)
    d = lengths[0]["d"]
    rows = rows.where(F.size("x") == d)
    model = fit(rows, d, most)
    k = len(model.values)
    if not k:
        return df.sparkSession.createDataFrame([], shape)
    error = float(np.abs(_products(rows, model.apply, k, model.n) - np.eye(k)).max())
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            of = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(of)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(of), model.n)),
                    "deviation": pa.array(_deviation(x, model.n, model.sums), pa.int64()).take(pa.array(of)),
                    "whitened": pa.array(model.apply(x).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(of), error)),
                }
            )

    return rows.select("vec_id", "x").mapInArrow(run, shape)
