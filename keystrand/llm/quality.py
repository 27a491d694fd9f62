"""Quality classifier: a regularised quadratic discriminant over document statistics.

Class covariances are shrunk towards their pooled mean and a multiple of the identity; a text's
evidence is the difference of its two log-densities, from Mahalanobis distances by Cholesky
factors kept with the model.  A logistic curve, fitted to a histogram of the squashed evidence,
turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, stats
from . import text as T

D = len(stats.FEATURES)
#: Shrinkage of a class's covariance towards the pooled one, and of that towards the identity.
TO_POOLED, TO_IDENTITY = 0.2, 0.05
LEAST_ROWS = 2


def is_held_out(doc_id: Column) -> Column:
    """Rows no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and the transformed statistics of each whole text, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                x = stats.features(stats.statistics(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * D, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "x"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return scratch.table(scratch.map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>"), "features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log-determinants, and the logistic curve."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_prior: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """log p(x | 1) - log p(x | 0) + log prior odds, squashed to sign * log(1 + |.|)."""
        if self.constant is not None:
            return np.zeros(len(x))
        logs = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        e = logs[1] - logs[0] + self.log_prior
        return np.sign(e) * np.log1p(np.abs(e))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, strictly between 0 and 1."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-(self.slope * self.evidence(x) + self.shift)))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products of x by y (0 or 1), from partial sums per task."""
    width = 1 + D + D * D

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            y, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(2 * width)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(2 * width)
    for at, v in scratch.map_arrow(rows.select("y", "x"), run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    out = out.reshape(2, width)
    return out[:, 0], out[:, 1 : 1 + D], out[:, 1 + D :].reshape(2, D, D)


def fit(rows: DataFrame) -> Discriminant:
    """The discriminant of rows (y, x).  All rows count; the driver gets sums and a histogram."""
    n, sums, products = moments(rows)
    if n.min() < LEAST_ROWS:
        constant = float((n[1] + 0.5) / (n.sum() + 1)) if n.sum() else 0.5
        return Discriminant(np.zeros((2, D)), np.zeros((2, D, D)), np.zeros(2), 0.0, constant=constant)
    means = sums / n[:, None]
    scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
    own, pooled = scatter / n[:, None, None], scatter.sum(axis=0) / n.sum()
    scale = np.diag(pooled).mean() * np.eye(D)
    target = (1 - TO_IDENTITY) * pooled + TO_IDENTITY * scale
    shrunk = [(1 - TO_POOLED) * ((1 - TO_IDENTITY) * s + TO_IDENTITY * scale) + TO_POOLED * target for s in own]
    lower = [np.linalg.cholesky(s + 1e-9 * np.eye(D)) for s in shrunk]
    model = Discriminant(means, np.stack([np.linalg.inv(c) for c in lower]), np.array([2 * np.log(np.diag(c)).sum() for c in lower]), float(np.log(n[1] / n[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.evidence(_matrix(batch.column(1))) * 20).astype(np.int32))], ["y", "bin"])

    bins = scratch.map_arrow(rows.select("y", "x"), run, "y int, bin int").groupBy("y", "bin").count().collect()
    y, e, w = (np.array(c, float) for c in zip(*bins))
    model.slope, model.shift = logistic(e / 20, y, w)
    return model


def logistic(e: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and shift of P(y = 1 | e) by penalised Newton steps; the slope stays positive."""
    beta, x = np.array([1.0, 0.0]), np.stack([e, np.ones_like(e)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * (beta - [1.0, 0.0])
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), grad)
        beta = beta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query op3: doc_id, held_out, score and predicted for each row of ``docs``.

    Learns from labelled rows that aren't held out.  Several labels of a doc_id count by their
    mean, null ones not at all; null and empty texts have zero statistics and a score; without
    two labels of each kind every score is the share of label 1 (0.5 without labels); repeated
    rows are scored each; an empty table gives no rows.
    """
    table = feature_table(docs)
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    model = fit(table.where(~is_held_out(F.col("doc_id"))).join(marks, "doc_id").select("y", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scratch.map_arrow(table.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "x"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject.

    The fitted model judges each row in place, so no row needs to be joined to its verdict."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = marks.where(~is_held_out(F.col("doc_id")))
    table = feature_table(docs.select("doc_id", "text").where(~is_held_out(F.col("doc_id"))))
    model = fit(table.join(known, "doc_id").select("y", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                yield part.filter(pa.array(model.score(stats.features(stats.statistics(part.column("text")))) >= 0.5))

    return scratch.map_arrow(docs, run, docs.schema)
