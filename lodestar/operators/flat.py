"""Exact search: top k, with a predicate, within a radius, by documents; reranking; strictness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.distance import Distance, distance
from lodestar.operators.scan import QUERY_BLOCK, SCORED_ROWS, Scorer, matrix, query_blocks, ranked, search


def exact_scorer(metric: str | Distance):
    matrix = distance(metric).matrix

    def of(q: np.ndarray) -> Scorer:
        every = np.arange(len(q))

        def score(columns: dict[str, np.ndarray]):
            b = columns["vec"].astype(np.float64)
            for a in range(0, len(b), SCORED_ROWS):
                part = b[a : a + SCORED_ROWS]
                yield every, np.arange(a, a + len(part)), matrix(q, part)

        return score

    return of


def flat_topk(base: DataFrame, queries: DataFrame, k: int, metric: str | Distance = "ip", where: Column | None = None, engine: str = "arrow", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, dist, rank): the k rows of ``base(id, vec)`` nearest to each of ``queries(qid, qvec)``.

    ``where`` is any predicate on the base's columns, applied before ranking. ``engine`` 'arrow'
    scores blocks of queries against Arrow batches; 'sql' is the same in column functions.
    """
    base = base if where is None else base.where(where)
    if engine == "arrow":
        return search(base.where(F.col("vec").isNotNull()).select("id", "vec"), ["vec"], queries, k, exact_scorer(metric), block)
    if engine != "sql":
        raise ValueError(f"unknown engine {engine!r}; arrow or sql")
    return ranked(all_distances(base, queries, metric), k)


def all_distances(base: DataFrame, queries: DataFrame, metric: str | Distance = "ip") -> DataFrame:
    """(qid, id, dist) of a stated query set against all rows; the queries' size is checked before they're broadcast."""
    small = queries.select("qid", "qvec")
    n = small.limit(QUERY_BLOCK + 1).count()
    small = F.broadcast(small) if n <= QUERY_BLOCK else small
    return base.join(small, F.lit(True)).select("qid", "id", distance(metric).column(F.col("qvec"), F.col("vec")).alias("dist"))


def closer_first(result: DataFrame) -> DataFrame:
    return result.orderBy("qid", "rank")


def require_k(result: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Raises if some query has fewer than k rows, as a strict search does."""
    counts = queries.select("qid").join(result.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left")
    if short := counts.where(F.coalesce("n", F.lit(0)) < k).limit(1).collect():
        raise ValueError(f"query {short[0]['qid']} has fewer than {k} rows; raise ef or loosen the filter")
    return result


def rerank(shortlist: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str | Distance = "ip") -> DataFrame:
    """Exact distances of a shortlist (qid, id), and the k best of each query."""
    pairs = base.select("id", "vec").join(shortlist.select("qid", "id"), "id").join(queries.select("qid", "qvec"), "qid")
    return ranked(pairs.select("qid", "id", distance(metric).column(F.col("qvec"), F.col("vec")).alias("dist")), k)


def epsilon_search(base: DataFrame, queries: DataFrame, epsilon: float, max_candidates: int | None = None, min_candidates: int = 0, metric: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, dist, rank): all rows within ``epsilon`` (inclusive, of the raw distance), or the nearest ``max_candidates`` of them.

    ``min_candidates`` belongs to graph searches, which look at as many before they stop; exact
    search looks at all.
    """
    if max_candidates is not None:
        if not 0 <= min_candidates <= max_candidates:
            raise ValueError("0 <= min_candidates <= max_candidates")
        # partitions keep max_candidates each, so the radius can be applied after
        return flat_topk(base, queries, max_candidates, metric).where(F.col("dist") <= epsilon)
    measure, rows = distance(metric).matrix, base.where(F.col("vec").isNotNull()).select("id", "vec")
    found = rows.sparkSession.createDataFrame([], "qid long, id long, dist double")
    for qids, q in query_blocks(queries, block):

        def run(batches: Iterator[pa.RecordBatch], qids=qids, q=q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    dist = measure(q, matrix(batch.column(1)).astype(np.float64))
                    i, j = np.nonzero(dist <= epsilon)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[i], pa.int64()), batch.column(0).take(pa.array(j)), pa.array(dist[i, j])], names=["qid", "id", "dist"])

        found = found.union(rows.mapInArrow(run, "qid long, id long, dist double"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")).cast("long"))


def document_search(base: DataFrame, queries: DataFrame, num_docs: int, metric: str | Distance = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, doc_id, id, dist, rank): vectors nearest first until ``num_docs`` documents are complete.

    ``base(id, doc_id, vec)``. A query's result are the vectors that come before the first vector of
    its (num_docs + 1)-th document. The first scan finds that bound: a partition keeps the first
    vectors of its ``num_docs + 1`` nearest documents, and the global ones are among these. The
    second scan returns what lies before it.
    """
    measure, keep = distance(metric).matrix, num_docs + 1
    rows = base.where(F.col("vec").isNotNull()).select("id", "doc_id", "vec")
    schema, found = "qid long, doc_id long, id long, dist double", None
    for qids, q in query_blocks(queries, block):
        firsts = rows.mapInArrow(_document_scan(qids, q, measure, keep, None), schema)
        first = firsts.groupBy("qid", "doc_id").agg(F.min(F.struct("dist", "id")).alias("first"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy("first"))
        bounds = {r["qid"]: tuple(r["first"]) for r in first.withColumn("place", place).where(F.col("place") == keep).collect()}  # one for each query of the block
        one = rows.mapInArrow(_document_scan(qids, q, measure, keep, bounds), schema)
        found = one if found is None else found.union(one)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")).cast("long"))


def _document_scan(qids: np.ndarray, q: np.ndarray, measure, keep: int, bounds: dict | None):
    """Without bounds the first vectors of the ``keep`` nearest documents of the partition, else all before the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frame(parts: list[tuple]) -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0)] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) if len(c) else pa.array([], k) for c, k in zip(columns, kinds, strict=True)], names=["qid", "doc_id", "id", "dist"])

        best: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, docs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            out = []
            for i, dist in enumerate(measure(q, matrix(batch.column(2)).astype(np.float64))):
                if bounds is not None:
                    limit, label = bounds.get(int(qids[i]), (np.inf, 0))
                    at = np.flatnonzero((dist < limit) | ((dist == limit) & (ids < label)))
                    out.append((np.full(len(at), qids[i]), docs[at], ids[at], dist[at]))
                    continue
                held = best.get(i)
                d, x, c = (dist, ids, docs) if held is None else (np.concatenate(p) for p in zip(held, (dist, ids, docs), strict=True))
                order = np.lexsort((x, d))
                _, first = np.unique(c[order], return_index=True)
                order = order[np.sort(first)[:keep]]
                best[i] = d[order], x[order], c[order]
            if bounds is not None:
                yield frame(out)
        if bounds is None:
            yield frame([(np.full(len(d), qids[i]), c, x, d) for i, (d, x, c) in best.items()])

    return run
