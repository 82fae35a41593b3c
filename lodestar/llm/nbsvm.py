"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import rounds, tidy
from lodestar.llm.linear import collect_vectors, held_out, labelled_sample, platt, sigmoid
from lodestar.llm.ngrams import distinct, text_buckets

BITS = 16
#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 4_000
EPOCHS, COST, SMOOTHING = 6, 1.0, 1.0
#: A text counts as good from this score on.
LEAST_SCORE = 0.3


def _indicators(text: str, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found = distinct(text_buckets(text, BITS), np.zeros(1 << BITS, dtype=bool) if seen is None else seen)
    return found, np.empty(0)


def log_count_ratios(at: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = [SMOOTHING + np.bincount(np.concatenate([x for x, y in zip(at, labels, strict=True) if y == k]), minlength=1 << BITS) for k in (0, 1)]
    bad, good = (c / c.sum() for c in counts)
    return np.log(good / bad)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights of the hinge-loss model, intercept last: each dual variable in turn is set to its best value."""
    w, sign = np.zeros((1 << BITS) + 1), np.where(labels == 1, 1.0, -1.0)
    dual, norm = np.zeros(len(rows)), [float(v @ v) + 1 for v in values]
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, v = rows[i], values[i]
            slope = sign[i] * (w[at] @ v + w[-1]) - 1
            best = min(max(dual[i] - slope / norm[i], 0.0), COST)
            step = (best - dual[i]) * sign[i]
            if step:
                w[at] += step * v
                w[-1] += step
                dual[i] = best
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality") -> dict:
    """The model, learned from rows that aren't held out; a fifth of them only sets the curve of the score.
    Without labels of both kinds, every score is the share of label 1, or 1 without any label."""
    at, _, y = collect_vectors(labelled_sample(docs, labels, label, rows, folds=True), _indicators)
    apart = np.arange(len(y)) % 5 == 0
    if len(set(y[~apart])) < 2:
        share = min(max(float(y.mean()) if len(y) else 1.0, 1e-6), 1 - 1e-6)
        return {"weights": np.zeros((1 << BITS) + 1), "ratios": np.zeros(1 << BITS), "slope": 0.0, "intercept": float(np.log(share / (1 - share)))}
    keep = np.flatnonzero(~apart)
    ratios = log_count_ratios([at[i] for i in keep], y[keep])
    values = [_scaled(ratios, x) for x in at]
    w = dual_descent([at[i] for i in keep], [values[i] for i in keep], y[keep])
    margins = np.array([v @ w[x] for x, v in zip(at, values, strict=True)]) + w[-1]
    slope, intercept = platt(margins[apart], y[apart])
    return {"weights": w, "ratios": ratios, "slope": slope, "intercept": intercept}


def _scaled(ratios: np.ndarray, at: np.ndarray) -> np.ndarray:
    v = ratios[at]
    return v / (np.sqrt(v @ v) + 1e-9)


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``, from its whole text alone.

    Null and empty texts have no n-grams and get the score of the intercept. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, w = np.zeros(1 << BITS, dtype=bool), model["weights"]
        for batch in batches:
            for at, texts in rounds(batch, 1):
                rows = [_indicators(t, seen)[0] for t in texts]
                margins = np.array([_scaled(model["ratios"], x) @ w[x] for x in rows]) + w[-1]
                scores = sigmoid(model["slope"] * margins + model["intercept"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scores)], names=["doc_id", "score"])

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    scored = picked.mapInArrow(tidy(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (scored["score"] >= LEAST_SCORE).cast("int").alias("predicted"))
