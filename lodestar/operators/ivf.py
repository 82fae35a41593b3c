"""Inverted lists: probe selection, fixed and confidence-adaptive, and exact search of the probed lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.distance import distance
from lodestar.operators.kmeans import kmeans
from lodestar.operators.scan import QUERY_BLOCK, matrix, query_blocks, ranked, scan_block


@dataclass
class InvertedLists:
    """Centroids, and the base with the list ``cid`` of each row."""

    centroids: np.ndarray
    assigned: DataFrame

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    def centroid_table(self) -> DataFrame:
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        return self.assigned.sparkSession.createDataFrame(rows, "cid long, cvec array<double>")

    def save(self, path: str) -> None:
        """Lists are folders of one cid each, so a search of some lists reads only these."""
        self.centroid_table().write.mode("overwrite").parquet(f"{path}/centroids")
        self.assigned.repartition("cid", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("cid").parquet(f"{path}/lists")

    @classmethod
    def load(cls, spark, path: str) -> InvertedLists:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()
        return cls(np.array([r["cvec"] for r in rows]), spark.read.parquet(f"{path}/lists").withColumn("cid", F.col("cid").cast("long")))


def build_lists(base: DataFrame, nlist: int, iterations: int = 10, **options) -> InvertedLists:
    return InvertedLists(*kmeans(base, nlist, iterations, **options))


def probe(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """(qid, cid, score, rank): the ``nprobe`` lists of greatest inner product, nprobe clamped to [1, nlist]."""
    nprobe = max(1, min(nprobe, len(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = matrix(batch.column(1)).astype(np.float64) @ centroids.T
                order = np.argsort(-score, axis=1, kind="stable")[:, :nprobe]
                qid = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), nprobe)
                rank = np.tile(np.arange(1, nprobe + 1), len(score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid, pa.int64()), pa.array(order.ravel(), pa.int64()), pa.array(np.take_along_axis(score, order, 1).ravel()), pa.array(rank, pa.int64())],
                    names=["qid", "cid", "score", "rank"],
                )

    rows = queries.where(F.col("qvec").isNotNull()).select("qid", "qvec")
    return rows.mapInArrow(run, "qid long, cid long, score double, rank long")


def adaptive_probe(queries: DataFrame, centroids: np.ndarray, min_nprobe: int, max_nprobe: int, tau: float, coverage: float) -> DataFrame:
    """(qid, cid, score, rank): the shortest prefix of the best lists whose softmax weights cover enough.

    Weights are exp((score - best score) / tau) over the best ``max_nprobe`` lists; at least
    ``min_nprobe`` are taken, and further ones while the weights so far are below ``coverage``.
    """
    low = max(1, min(min_nprobe, len(centroids)))
    high = max(low, min(max_nprobe, len(centroids)))
    tau, coverage = max(tau, 1e-8), min(max(coverage, 0.0), 1.0)
    best = Window.partitionBy("qid").orderBy("rank")
    weighed = probe(queries, centroids, high).withColumn("weight", F.exp((F.col("score") - F.max("score").over(Window.partitionBy("qid"))) / tau))
    share = weighed.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("qid")))
    before = F.coalesce(F.sum("share").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return share.withColumn("before", before).where((F.col("rank") <= low) | (F.col("before") < coverage)).select("qid", "cid", "score", "rank")


def _probed(probes: DataFrame, qids: np.ndarray) -> dict[int, np.ndarray]:
    """For each list the indices of the block's queries that probe it; block x nprobe rows at most."""
    rows = probes.where(F.col("qid").between(int(qids[0]), int(qids[-1]))).select("qid", "cid").toArrow()
    own, cid = np.asarray(rows.column("qid")), np.asarray(rows.column("cid"))
    at = np.minimum(np.searchsorted(qids, own), len(qids) - 1)
    known = qids[at] == own
    order = np.lexsort((at[known], cid[known]))
    at, cid = at[known][order], cid[known][order]
    lists, first = np.unique(cid, return_index=True)
    return dict(zip(lists.tolist(), np.split(at, first[1:]), strict=True)) if len(lists) else {}


def ivf_search(index: InvertedLists, queries: DataFrame, probes: DataFrame, k: int, metric: str = "ip", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, dist, rank): the k best rows of the lists that each query probes.

    Only valid pairs are scored: each batch's rows of one list against the queries that probe it.
    Lists that no query probes are pruned from the scan.
    """
    measure = distance(metric).matrix
    found = None
    for qids, q in query_blocks(queries, block):
        lists = _probed(probes, qids)

        def score(columns: dict[str, np.ndarray], q=q, lists=lists):
            for c in np.unique(columns["cid"]).tolist():
                if c in lists:
                    rows = np.flatnonzero(columns["cid"] == c)
                    yield lists[c], rows, measure(q[lists[c]], columns["vec"][rows].astype(np.float64))

        rows = index.assigned.where(F.col("cid").isin(sorted(lists))).select("id", "vec", "cid")
        part = scan_block(rows, ["vec"], qids, k, score)
        found = part if found is None else found.union(part)
    return ranked(found, k)


def candidate_pairs(index: InvertedLists, probes: DataFrame) -> DataFrame:
    """(qid, id): the valid pairs themselves, an equi-join of probes and lists."""
    return index.assigned.select("id", "cid").join(probes.select("qid", "cid"), "cid").select("qid", "id")


def candidate_counts(index: InvertedLists, probes: DataFrame) -> DataFrame:
    """(qid, nprobe, candidates) from the lists' sizes, without making the pairs."""
    sizes = index.assigned.groupBy("cid").agg(F.count("*").alias("n"))
    return probes.join(sizes, "cid", "left").groupBy("qid").agg(F.count("*").alias("nprobe"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


def union_rows(index: InvertedLists, probes: DataFrame) -> DataFrame:
    """Rows of all lists that any query probes, once each."""
    return index.assigned.join(probes.select("cid").distinct(), "cid", "left_semi")


def union_search(index: InvertedLists, queries: DataFrame, probes: DataFrame, k: int, metric: str = "ip", block: int = QUERY_BLOCK) -> DataFrame:
    """The search of ``ivf_search`` by scoring the union of a block's probed lists and masking invalid pairs."""
    measure = distance(metric).matrix
    found = None
    for qids, q in query_blocks(queries, block):
        lists = _probed(probes, qids)
        valid = np.zeros((len(qids), index.nlist), dtype=bool)
        for c, own in lists.items():
            valid[own, c] = True

        def score(columns: dict[str, np.ndarray], q=q, valid=valid):
            dist = measure(q, columns["vec"].astype(np.float64))
            yield np.arange(len(q)), np.arange(dist.shape[1]), np.where(valid[:, columns["cid"]], dist, np.inf)

        rows = index.assigned.where(F.col("cid").isin(sorted(lists))).select("id", "vec", "cid")
        part = scan_block(rows, ["vec"], qids, k, score).where(F.col("dist") < float("inf"))
        found = part if found is None else found.union(part)
    return ranked(found, k)
