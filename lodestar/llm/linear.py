"""What the text classifiers share: labelled samples, hashed vectors, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import rounds, tidy

#: Labels are learned only from rows whose crc32(doc_id as text) leaves a remainder when divided by this.
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where the crc32 of the id as text is divisible by FOLDS; null ids are never labelled."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: bool) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, those of the least hashes.

    Rows without an id or label don't count; of several labels or texts of one id the least is
    taken. With ``folds``, held-out rows are left out.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if folds:
        known = known.where(~held_out())
    picked = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``rows`` rows are broadcast
    return joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def collect_vectors(sample: DataFrame, vector: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> tuple[list, list, np.ndarray]:
    """Buckets, values and labels of a bounded sample on the driver, in the order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in rounds(batch, 1):
                found = [vector(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        batch.column(2).slice(at, len(texts)),
                        pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary()),
                        pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
                    ],
                    names=["doc_id", "label", "buckets", "vals"],
                )

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sorted(sample.mapInArrow(tidy(run), f"doc_id {kind}, label int, buckets binary, vals binary").collect())
    return (
        [np.frombuffer(r["buckets"], dtype=np.int32) for r in rows],
        [np.frombuffer(r["vals"], dtype=np.float32) for r in rows],
        np.array([r["label"] for r in rows], dtype=np.int64),
    )


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of margins, with smoothed targets, by Newton steps."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.column_stack((margins, np.ones(len(margins))))
    beta = np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(np.sum(np.logaddexp(0, z) - target * z)) + 1e-3 * float(b @ b)

    for _ in range(50):
        p = sigmoid(design @ beta)
        gradient = design.T @ (p - target) + 2e-3 * beta
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 2e-3 * np.eye(2)
        step, scale = np.linalg.solve(curve, gradient), 1.0
        while loss(beta - scale * step) > loss(beta) and scale > 1e-4:
            scale /= 2
        beta = beta - scale * step
        if np.abs(scale * step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])
