"""The one scan under every search: a block of queries against all rows, best k of each partition.

Queries come to the driver in blocks of at most QUERY_BLOCK and go out with the task; rows stay where
they are. Each task keeps k rows of each query and a merge by query keeps k of these, which is exact
since every global best is a best of its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries of one pass over the rows.
QUERY_BLOCK = 2_048
#: Rows that are scored against a whole block in one go; a batch of rows would make matrices of hundreds of MB.
SCORED_ROWS = 1_024
#: Pairs that a task holds before it cuts them down to k for each query.
HELD = 2_000_000

#: From a batch's columns: (query indices, row indices, distances of all their pairs), as often as needed.
Scorer = Callable[[dict[str, np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, matrix) in order of qid. Queries that fit one block come as Arrow in one go, more are streamed."""
    known = queries.select("qid", "qvec").where(F.col("qvec").isNotNull())
    head = known.limit(block + 1).toArrow()
    if head.num_rows <= block:
        if head.num_rows:
            ids = np.asarray(head.column("qid"))
            order = np.argsort(ids, kind="stable")
            yield ids[order], matrix(head.column("qvec")).astype(np.float64)[order]
        return
    ids, vectors = [], []
    for r in known.orderBy("qid").toLocalIterator():
        ids.append(r["qid"])
        vectors.append(r["qvec"])
        if len(ids) == block:
            yield np.array(ids), np.array(vectors, dtype=np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.array(vectors, dtype=np.float64)


class BestK:
    """The k least (distance, id) of each query."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, q: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        if not dist.size:
            return
        if dist.shape[1] > self.k:
            limit = np.partition(dist, self.k - 1, axis=1)[:, self.k - 1]
            row, col = np.nonzero(dist <= limit[:, None])  # with all ties
        else:
            row, col = (x.ravel() for x in np.indices(dist.shape))
        self.parts.append((q[row], ids[col], dist[row, col]))
        self.held += len(row)
        if self.held > HELD:
            self.parts = [self.best()]
            self.held = len(self.parts[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, ids, dist = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, dist, q))
        q, ids, dist = q[order], ids[order], dist[order]
        first = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = place < self.k
        return q[keep], ids[keep], dist[keep]


def scan_block(rows: DataFrame, vectors: list[str], qids: np.ndarray, k: int, scorer: Scorer) -> DataFrame:
    """(qid, id, dist): the best k of each query in each partition of ``rows``, a table with ``id``."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestK(k)
        for batch in batches:
            if batch.num_rows:
                columns = {n: matrix(c) if n in vectors else c.to_numpy(zero_copy_only=False) for n, c in zip(names, batch.columns, strict=True)}
                for q, r, dist in scorer(columns):
                    best.add(q, columns["id"][r], dist)
        q, ids, dist = best.best()
        yield pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())], names=["qid", "id", "dist"])

    return rows.mapInArrow(run, "qid long, id long, dist double")


def ranked(candidates: DataFrame, k: int, order: str = "dist") -> DataFrame:
    """The k best of each qid with their rank from 1, ties by id."""
    window = Window.partitionBy("qid").orderBy(order, "id")
    return candidates.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= k)


def search(rows: DataFrame, vectors: list[str], queries: DataFrame, k: int, scorer_of: Callable[[np.ndarray], Scorer], block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, dist, rank) of all queries, a pass over ``rows`` for each block of them."""
    found = [scan_block(rows, vectors, qids, k, scorer_of(q)) for qids, q in query_blocks(queries, block)]
    if not found:
        return rows.sparkSession.createDataFrame([], "qid long, id long, dist double, rank long")
    return ranked(reduce(DataFrame.union, found), k)
