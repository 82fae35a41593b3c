"""Product quantization: sampled codebooks with inner-product codes, residual codebooks by k-means, scans by table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.operators.ivf import InvertedLists, _probed
from lodestar.operators.kmeans import SEED_STRIDE, take_rows
from lodestar.operators.scan import HELD, QUERY_BLOCK, BestK, matrix, query_blocks, ranked
from lodestar.sources.shared import shared_folder

#: Added to the row number of codebook and residual samples.
CODEBOOK_SEED, RESIDUAL_SEED = 42, 123
#: Rows that are scored against a block of queries in one go.
PIECE_ROWS = 1_000
#: Bins of a pass that looks for where shortlists end, passes at most, and rows of a query at the end that are few enough, in the mean.
BINS, PASSES, EDGE_ROWS = 256, 4, 32


@dataclass
class Codebook:
    """``words[m, k]`` is codeword k of subspace m."""

    words: np.ndarray
    residual: bool = False

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.words.shape

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[query, m, k]: the product of a query's part m and codeword k."""
        m, _, d = self.shape
        return np.einsum("qmd,mkd->qmk", q.reshape(len(q), m, d), self.words)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The rows' codewords side by side."""
        return self.words[np.arange(self.shape[0]), codes].reshape(len(codes), -1)

    def table(self, spark) -> DataFrame:
        m, ks, _ = self.shape
        return spark.createDataFrame([(i, k, self.words[i, k].tolist()) for i in range(m) for k in range(ks)], "m long, k long, word array<double>")


def check_shape(d: int, m: int, ks: int) -> None:
    if m <= 0 or d % m or not 0 < ks <= 256:
        raise ValueError("the dimension must be a multiple of M > 0, and 0 < Ks <= 256")


def sample_codebook(base: DataFrame, m: int, ks: int) -> Codebook:
    """Codeword (m, k) is part m of row ((m * Ks + k) * 9973 + 42) mod n; nothing is trained."""
    n = base.count()
    first = base.select(F.size("vec").alias("d")).first()
    if first is None:
        raise ValueError("a codebook needs rows")
    check_shape(first["d"], m, ks)
    size = first["d"] // m
    wanted = {(i, k): ((i * ks + k) * SEED_STRIDE + CODEBOOK_SEED) % n for i in range(m) for k in range(ks)}
    have = take_rows(base, list(wanted.values()))
    if len(have) < len(set(wanted.values())):
        raise ValueError("ids must be the row numbers 0 to n - 1")
    words = np.zeros((m, ks, size))
    for (i, k), row in wanted.items():
        words[i, k] = have[row][i * size : (i + 1) * size]
    return Codebook(words)


def _codes(rows: np.ndarray, words: np.ndarray, metric: str) -> np.ndarray:
    m, _, size = words.shape
    out = np.empty((len(rows), m), dtype=np.int16)
    for i in range(m):
        part = rows[:, i * size : (i + 1) * size]
        if metric == "ip":
            out[:, i] = np.argmax(part @ words[i].T, axis=1)
        else:
            out[:, i] = np.argmin(((part[:, None, :] - words[i][None]) ** 2).sum(axis=2), axis=1)
    return out


def encode_table(rows: DataFrame, book: Codebook, centroids: np.ndarray | None = None) -> DataFrame:
    """``rows`` without ``vec`` but with ``code array<smallint>``: the codeword of greatest product, or for a
    residual codebook the nearest to the row's part less its centroid's. Ties go to the lowest codeword."""
    at = rows.columns.index("vec")
    kept = [c for c in rows.columns if c != "vec"]
    cid = rows.columns.index("cid") if book.residual else None
    words = book.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = matrix(batch.column(at)).astype(np.float64)
            if cid is not None:
                own = own - centroids[batch.column(cid).to_numpy(zero_copy_only=False)]
            parts = [_codes(own[a : a + 2_000], words, "l2" if cid is not None else "ip") for a in range(0, len(own), 2_000)]
            codes = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), lists], names=[*kept, "code"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("code", T.ArrayType(T.ShortType())))


def lookup_tables(queries: DataFrame, book: Codebook) -> DataFrame:
    """(qid, lut): the products of each query's parts with all codewords, codeword k of part m at m * Ks + k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = book.tables(matrix(batch.column(1)).astype(np.float64)).reshape(batch.num_rows, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * t.shape[1]), pa.array(t.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["qid", "lut"])

    return queries.select("qid", "qvec").mapInArrow(run, "qid long, lut array<double>")


def _pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of each pair of rows, added up one coordinate after the other as the columns' form does: equal pairs give equal sums."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


class _Scores:
    """Table scores of a block of queries against batches of codes, in pieces of bounded size.

    A table score is the product of the query and the row's codewords, so a matrix product gives it but for
    rounding, by less than ``slack``. It tells which pairs can't matter; those left are added up from the tables' products.
    """

    def __init__(self, book: Codebook, q: np.ndarray, lists: dict[int, np.ndarray] | None = None, centroids: np.ndarray | None = None):
        self.book, self.q, self.lists = book, q, lists
        self.roots = q @ centroids.T if book.residual else None
        longest = np.sqrt((book.words**2).sum(axis=2).max(axis=1).sum())
        size = np.sqrt((q * q).sum(axis=1)) * longest + (0 if self.roots is None else np.abs(self.roots).max(axis=1))
        self.slack = 1e-12 * (1 + size)
        #: No score, negative as distances are, lies outside these.
        self.low, self.high = -size - self.slack, size + self.slack

    def pieces(self, columns: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(query indices, row indices, negative scores of all their pairs, the list's own part of them) of the valid pairs."""
        codes = columns["code"]
        near = [(None, np.arange(len(codes)))] if self.lists is None else [(c, np.flatnonzero(columns["cid"] == c)) for c in np.unique(columns["cid"]).tolist() if c in self.lists]
        for c, rows in near:
            own = np.arange(len(self.q)) if c is None else self.lists[c]
            root = None if self.roots is None else self.roots[own, c]
            for a in range(0, len(rows), PIECE_ROWS):
                part = rows[a : a + PIECE_ROWS]
                score = self.q[own] @ self.book.decoded(codes[part]).T
                yield own, part, -(score if root is None else score + root[:, None]), root

    def exact(self, codes: np.ndarray, own: np.ndarray, part: np.ndarray, root: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The table scores of the pairs (own[i], part[j])."""
        m, _, size = self.book.shape
        q, code, out = self.q[own[i]], codes[part[j]], np.zeros(len(i))
        for x in range(m):
            out += _pair_sums(q[:, x * size : (x + 1) * size], self.book.words[x, code[:, x]])
        return out if root is None else out + root[i]


class _Least(BestK):
    """The k least of pairs, of which only those are looked at that aren't beyond the k so far."""

    def __init__(self, k: int, n_queries: int, slack: np.ndarray):
        super().__init__(k)
        self.worst, self.slack = np.full(n_queries, np.inf), slack

    def close(self, own: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit = self.worst[own]
        if np.isinf(limit).any() and dist.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
        return np.nonzero((dist <= (limit + self.slack[own])[:, None]) & (dist < np.inf))

    def take(self, q: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        self.parts.append((q, ids, dist))
        self.held += len(q)
        if self.held > min(HELD, 8 * self.k * len(self.worst)) or np.isinf(self.worst).any():
            own, _, dist = self.parts[0] = self.best()
            del self.parts[1:]
            self.held = len(own)
            last = np.flatnonzero(np.diff(np.append(own, -1)))
            full = last[np.diff(np.append(-1, last)) == self.k]
            self.worst[own[full]] = dist[full]


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: matrix(c) if n in ("vec", "code") else c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _blocks(rows: DataFrame, book: Codebook, queries: DataFrame, probes: DataFrame | None, centroids: np.ndarray | None) -> Iterator[tuple[np.ndarray, _Scores, DataFrame]]:
    """For each block of queries their scores, and the rows without lists that none of them probes."""
    for qids, q in query_blocks(queries, QUERY_BLOCK):
        lists = None if probes is None else _probed(probes, qids)
        yield qids, _Scores(book, q, lists, centroids), rows if lists is None else rows.where(F.col("cid").isin(sorted(lists)))


def _scan_lists(coded: DataFrame, book: Codebook, centroids: np.ndarray, queries: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(qid, id, dist), the best k of each partition: 1 less the table score of the rows of probed lists."""
    found = None
    for qids, scores, rows in _blocks(coded.select("id", "code", "cid"), book, queries, probes, centroids):

        def run(batches: Iterator[pa.RecordBatch], qids=qids, scores=scores) -> Iterator[pa.RecordBatch]:
            best = _Least(k, len(qids), scores.slack)
            for columns in (_columns(b) for b in batches if b.num_rows):
                for own, part, dist, root in scores.pieces(columns):
                    i, j = best.close(own, 1 + dist)
                    best.take(own[i], columns["id"][part[j]], 1 - scores.exact(columns["code"], own, part, root, i, j))
            q, ids, dist = best.best()
            yield pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())], names=["qid", "id", "dist"])

        part = rows.mapInArrow(run, "qid long, id long, dist double")
        found = part if found is None else found.union(part)
    return found


def _edges(rows: DataFrame, scores: _Scores, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query an interval of negative scores in which its ``keep``-th row lies (infinite if it has no more rows).

    A pass counts rows by BINS bins of the interval, and the bin that the row is in is the next interval. Only
    counts leave a task, BINS for each query at most.
    """
    n, low, high = len(scores.q), scores.low.copy(), scores.high.copy()
    for step in range(PASSES):
        scale = BINS / (high - low)
        scale[~np.isfinite(low)] = 1.0

        def run(batches: Iterator[pa.RecordBatch], low=low, scale=scale) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((n, BINS + 2), dtype=np.int64)
            for columns in (_columns(b) for b in batches if b.num_rows):
                for own, _, score, _ in scores.pieces(columns):
                    at = np.clip(np.floor((score - low[own, None]) * scale[own, None]), -1, BINS).astype(np.int64) + 1
                    at += np.arange(len(own))[:, None] * (BINS + 2)
                    counts[own] += np.bincount(at.ravel(), minlength=len(own) * (BINS + 2)).reshape(len(own), -1)
            i, b = np.nonzero(counts[:, :-1])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), pa.array(counts[i, b])], names=["i", "bin", "n"])

        found = rows.mapInArrow(run, "i long, bin long, n long").groupBy("i", "bin").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((n, BINS + 1), dtype=np.int64)
        counts[np.asarray(found.column("i")), np.asarray(found.column("bin"))] = np.asarray(found.column("n"))
        before = counts.cumsum(axis=1)
        at = np.minimum((before < keep).sum(axis=1), BINS)  # rounding may put the row just outside
        width = (high - low) / BINS
        if step == 0:
            low[before[:, -1] <= keep] = high[before[:, -1] <= keep] = np.inf
        known = np.isfinite(low)
        low[known] += (np.maximum(at, 1) - 1)[known] * width[known]
        high[known] = low[known] + width[known]
        if counts[np.arange(n), at][known].sum() <= EDGE_ROWS * max(1, known.sum()):
            break
    return low, high


def _reranked(rows: DataFrame, book: Codebook, queries: DataFrame, k: int, keep: int, probes: DataFrame | None = None, centroids: np.ndarray | None = None) -> DataFrame:
    """(qid, id, dist): the k best by exact product of the ``keep`` rows of greatest table score, ties by id.

    ``rows(id, vec, code, cid)``; without ``probes`` all are scored. A shortlist is a share of the table, so it's never
    listed: passes over the scores find where it ends, and the last one scores exactly, where they lie, the
    rows before that. It gives k rows of each query and task, how many rows were before the end, and the few rows at it.
    """
    names, found = ["id", "vec", "code", *(["cid"] if probes is not None else [])], None
    for qids, scores, own_rows in _blocks(rows.select(*names), book, queries, probes, centroids):
        low, high = _edges(own_rows, scores, keep)

        def run(batches: Iterator[pa.RecordBatch], qids=qids, scores=scores, low=low, high=high) -> Iterator[pa.RecordBatch]:
            q, before = scores.q, np.zeros(len(qids), dtype=np.int64)
            best = _Least(k, len(qids), 1e-12 * (1 + np.abs(q).sum(axis=1)))

            def frame(own: np.ndarray, ids: np.ndarray, dist: np.ndarray, score: np.ndarray | None = None) -> pa.RecordBatch:
                edge = pa.nulls(len(own), pa.float64()) if score is None else pa.array(score)
                return pa.RecordBatch.from_arrays(
                    [pa.array(qids[own], pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64()), edge, pa.array(np.zeros(len(own), np.int64))], names=["qid", "id", "dist", "edge", "n"]
                )

            for columns in (_columns(b) for b in batches if b.num_rows):
                ids, vec = columns["id"], columns["vec"].astype(np.float64)
                for own, part, score, root in scores.pieces(columns):
                    sure = score < (low - scores.slack)[own, None]
                    before[own] += sure.sum(axis=1)
                    i, j = best.close(own, np.where(sure, 1 - q[own] @ vec[part].T, np.inf))
                    best.take(own[i], ids[part[j]], 1 - _pair_sums(q[own[i]], vec[part[j]]))
                    i, j = np.nonzero(~sure & (score <= (high + scores.slack)[own, None]))
                    if len(i):
                        yield frame(own[i], ids[part[j]], 1 - _pair_sums(q[own[i]], vec[part[j]]), -scores.exact(columns["code"], own, part, root, i, j))
            yield frame(*best.best())
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), *(pa.nulls(len(qids), t) for t in (pa.int64(), pa.float64(), pa.float64())), pa.array(before)], names=["qid", "id", "dist", "edge", "n"])

        part = own_rows.mapInArrow(run, "qid long, id long, dist double, edge double, n long")
        found = part if found is None else found.union(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "qid long, id long, dist double")
    place = F.row_number().over(Window.partitionBy("qid", F.col("edge").isNull()).orderBy("edge", "id"))
    fits = F.col("edge").isNull() | (F.col("place") <= keep - F.col("before"))
    placed = found.withColumn("before", F.sum("n").over(Window.partitionBy("qid"))).withColumn("place", place)
    return placed.where(F.col("id").isNotNull() & fits).select("qid", "id", "dist")


def _with_vectors(codes: DataFrame, base: DataFrame) -> DataFrame:
    """``codes`` with the rows' vectors, written once for all passes over them."""
    spark = codes.sparkSession
    path = shared_folder(spark, "codes")
    vectors = base.where(F.col("vec").isNotNull()).select("id", "vec")
    codes.drop("vec").join(vectors, "id").repartition(2 * spark.sparkContext.defaultParallelism, "id").write.parquet(path)
    return spark.read.parquet(path)


def pq_search(base: DataFrame, codes: DataFrame, book: Codebook, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """The ``nprobe`` rows of greatest table score, reranked by exact inner product."""
    return ranked(_reranked(_with_vectors(codes.select("id", "code"), base), book, queries, k, max(nprobe, k)), k)


def ivfpq_search(index: InvertedLists, coded: DataFrame, book: Codebook, queries: DataFrame, probes: DataFrame, k: int, rerank_r: int | None) -> DataFrame:
    """Table scores over the probed lists; the best ``rerank_r`` (at least k) are reranked exactly, or with
    None the scores stand. ``coded(id, cid, code)``."""
    if rerank_r is None:
        return ranked(_scan_lists(coded, book, index.centroids, queries, probes, k), k)
    rows = _with_vectors(coded.select("id", "cid", "code"), index.assigned)
    return ranked(_reranked(rows, book, queries, k, max(rerank_r, k), probes, index.centroids), k)


def ivfpq_search_by_part(index: InvertedLists, coded: DataFrame, book: Codebook, queries: DataFrame, probes: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Each part of ``coded(id, cid, code, part)`` makes a shortlist of ``nprobe`` (at least k) of its own;
    all are reranked and merged, so the result depends on the parts."""
    rows = _with_vectors(coded.select("id", "cid", "code", "part"), index.assigned)
    parts = sorted(r["part"] for r in rows.select("part").distinct().collect())
    found = [_reranked(rows.where(F.col("part") == p), book, queries, k, max(nprobe, k), probes, index.centroids) for p in parts]
    return ranked(reduce(DataFrame.union, found), k)


def train_residual_codebook(index: InvertedLists, m: int, ks: int, samples: int, iterations: int = 6) -> Codebook:
    """K-means of each subspace on residuals of ``samples`` rows, the subspaces side by side.

    Sample i is row (i * 9973 + 123) mod n; at least Ks are taken. Codeword k starts as sample
    k mod samples, and an empty one keeps its value.
    """
    n = index.assigned.count()
    d = index.centroids.shape[1]
    check_shape(d, m, ks)
    samples, size = max(samples, ks), d // m
    wanted = [(i * SEED_STRIDE + RESIDUAL_SEED) % n for i in range(samples)]
    rows = {r["id"]: (r["vec"], r["cid"]) for r in index.assigned.where(F.col("id").isin(sorted(set(wanted)))).select("id", "vec", "cid").collect()}
    residuals = np.array([np.array(rows[i][0], dtype=np.float64) - index.centroids[rows[i][1]] for i in wanted])

    def train(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        part = residuals[:, key[0] * size : (key[0] + 1) * size]
        words = part[np.arange(ks) % samples].copy()
        for _step in range(iterations):
            near = np.argmin(((part[:, None, :] - words[None]) ** 2).sum(axis=2), axis=1)
            counts = np.bincount(near, minlength=ks)
            sums = np.zeros_like(words)
            np.add.at(sums, near, part)
            words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
        return pd.DataFrame({"m": key[0], "word": [words.ravel().tolist()]})

    parts = index.assigned.sparkSession.range(m).select(F.col("id").alias("m")).groupBy("m").applyInPandas(train, "m long, word array<double>")
    words = {r["m"]: np.array(r["word"]).reshape(ks, size) for r in parts.collect()}
    return Codebook(np.array([words[i] for i in range(m)]), residual=True)
