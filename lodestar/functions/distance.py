"""Distances between vectors, as columns and in numpy; smaller is closer.

Scores are doubles whatever the stored type. A column form keeps the plan in the JVM, the numpy
form scores a block of queries against an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def integer_dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long"))
    return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)


def integer_squared_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("long") - y.cast("long"))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x * x)


#: Added to a norm before dividing by it, so that a zero vector stays zero.
TINY = 1e-30


def normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v)) + TINY
    return F.transform(v, lambda x: x.cast("double") / norm)


def normalized_rows(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    return m / (np.sqrt((m * m).sum(axis=-1, keepdims=True)) + TINY)


#: Matrix products add up the last rows of a matrix in another order, unless their number is a multiple of this.
FULL_ROWS = 64


def _products(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """q @ b.T where equal rows of ``b`` have equal products, so that ties are ties."""
    if more := -len(b) % FULL_ROWS:
        return (q @ np.concatenate((b, np.zeros((more, b.shape[1]), b.dtype))).T)[:, : len(b)]
    return q @ b.T


#: Differences that are held at once: they stay in a core's cache.
HELD_GAPS = 1 << 16


def _l2_matrix(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(b)))
    rows = max(1, HELD_GAPS // max(1, q.shape[1]))
    for a in range(0, len(b), rows):
        near = b[a : a + rows]
        together = max(1, rows // len(near))
        for i in range(0, len(q), together):  # differences, not the expanded square, which cancels for close vectors
            gap = near[None] - q[i : i + together, None]
            out[i : i + together, a : a + rows] = np.einsum("qij,qij->qi", gap, gap)
    return out


@dataclass(frozen=True)
class Distance:
    """``column(query, base)`` and ``matrix(queries, base)`` give the same numbers."""

    name: str
    column: Callable[[Column, Column], Column]
    matrix: Callable[[np.ndarray, np.ndarray], np.ndarray]


_known: dict[str, Distance] = {}


def register_distance(name: str, column: Callable[[Column, Column], Column], matrix: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Distance:
    _known[name] = Distance(name, column, matrix)
    return _known[name]


def distance(metric: str | Distance) -> Distance:
    if isinstance(metric, Distance):
        return metric
    if metric not in _known:
        raise ValueError(f"unknown space {metric!r}; one of {', '.join(sorted(_known))}")
    return _known[metric]


register_distance("ip", lambda q, b: 1 - dot(q, b), lambda q, b: 1 - _products(q, b))
register_distance("l2", squared_l2, _l2_matrix)
register_distance("cosine", lambda q, b: 1 - dot(normalized(q), normalized(b)), lambda q, b: 1 - _products(normalized_rows(q), normalized_rows(b)))
register_distance(
    "l2_int",
    integer_squared_l2,
    lambda q, b: _l2_matrix(q.astype(np.int64).astype(np.float64), b.astype(np.int64).astype(np.float64)),
)
