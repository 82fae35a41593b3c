"""Quality rules: counts of each text, and a calibrated logistic regression against a fixed threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import BLANK, mix, rounds, span_hashes, tidy, word_spans
from lodestar.llm.linear import collect_vectors, labelled_sample, platt, sigmoid
from lodestar.llm.ngrams import buckets, text_buckets

BITS = 16
#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 2_000
#: A text goes if its calibrated probability of good quality is lower.
LEAST_PROBABILITY = 0.5
#: Texts with fewer words, or with more repeated words of a hundred, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_W1, _W2, _W3 = (np.uint64(x) for x in np.random.default_rng(11).integers(1, 1 << 63, 3) | 1)


def _vector(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(found) < 1 << (BITS - 1):
        at, counts = np.unique(found, return_counts=True)
    else:  # as many as there are buckets: counting them all takes less than sorting
        counts = np.bincount(found, minlength=1 << BITS)
        at = np.flatnonzero(counts)
        counts = counts[at]
    values = np.sqrt(counts)
    return at, values / max(1e-9, float(np.sqrt(values @ values)))


def _text_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    return _vector(text_buckets(text, BITS))


def fit_logistic(at: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, steps: int = 120, decay: float = 1e-5) -> np.ndarray:
    """Weights by accelerated gradient steps over all rows at once; the last weight is the intercept."""
    flat, vals = np.concatenate(at), np.concatenate(values).astype(np.float64)
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    size, n = 1 << BITS, len(at)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # both classes count the same
    w, look, momentum = np.zeros(size + 1), np.zeros(size + 1), 1.0
    rate = 4.0  # the rows have length 1, with the intercept sqrt(2), and mean weight 1; bounds the curvature by 1/2
    for _ in range(steps):
        z = np.bincount(row, vals * look[flat], minlength=n) + look[size]
        pull = weight * (sigmoid(z) - labels) / n
        gradient = decay * look
        gradient[:size] += np.bincount(flat, vals * pull[row], minlength=size)
        gradient[size] += pull.sum()
        new = look - rate * gradient
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """The model: weights, and the curve from margins to probabilities, fitted on a fifth of the sample
    that the weights haven't seen. Without labels of both kinds, every text has probability 1."""
    at, values, y = collect_vectors(labelled_sample(docs, labels, "quality", rows, folds=False), _text_vector)
    apart = np.arange(len(y)) % 5 == 0
    if len(set(y[~apart])) < 2:
        return {"weights": np.zeros((1 << BITS) + 1), "slope": 0.0, "intercept": 30.0}
    keep = np.flatnonzero(~apart)
    w = fit_logistic([at[i] for i in keep], [values[i] for i in keep], y[keep])
    margins = np.array([v @ w[x] for x, v in zip(at, values, strict=True)]) + w[-1]
    slope, intercept = platt(margins[apart], y[apart])
    return {"weights": w, "slope": slope, "intercept": intercept}


def measure(text: str, model: dict) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = word_spans(data, BLANK)
    n = len(starts)
    word_chars = int(np.count_nonzero(((data & 0xC0) != 0x80) & ~BLANK[data]))
    symbols = int(np.count_nonzero(_SYMBOL[data]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        words = span_hashes(data, starts, ends)
        windows = mix(words[:-2] * _W1 + words[1:-1] * _W2 + words[2:] * _W3)
        _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[place] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeated = int(np.count_nonzero(covered))
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    at, values = _vector(buckets(data, starts, ends, BITS))
    p = float(sigmoid(model["slope"] * (values @ model["weights"][at] + model["weights"][-1]) + model["intercept"]))
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, failed, p


def apply_rules(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept).

    One row for each row of ``docs``, whole texts, no shuffle. Null and empty texts have no words
    and fail; repeated rows are judged each; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in rounds(batch, 1):
                found = list(zip(*(measure(t, model) for t in texts), strict=True))
                kept = [not f and p >= LEAST_PROBABILITY for f, p in zip(found[5], found[6], strict=True)]
                arrays = [pa.array(x, t) for x, t in zip(found, [pa.int64()] * 5 + [pa.bool_(), pa.float64()], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *arrays, pa.array(kept)], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    longs = ", ".join(f"{x} long" for x in names[1:6])
    return picked.mapInArrow(tidy(run), f"doc_id {kind}, {longs}, base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns as they are, that the rules keep; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in rounds(batch, column):
                found = [measure(t, model) for t in texts]
                kept = pa.array([not f[5] and f[6] >= LEAST_PROBABILITY for f in found], pa.bool_())
                yield batch.slice(at, len(texts)).filter(kept)

    column = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots or twice in the table can't go by name
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)
