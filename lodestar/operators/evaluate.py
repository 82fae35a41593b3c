"""Recall and other figures of searches, as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(result: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, hits, recall) of every query, also those without a hit."""
    hits = result.select("qid", "id").distinct().join(truth.where(F.col("rank") <= k).select("qid", "id"), ["qid", "id"], "left_semi")
    counts = hits.groupBy("qid").agg(F.count("*").alias("hits"))
    n = F.coalesce("hits", F.lit(0)).cast("long")
    return queries.select("qid").join(counts, "qid", "left").select("qid", n.alias("hits"), (n / k).alias("recall"))


def mean_recall(result: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return recall(result, truth, queries, k).agg(F.avg("recall").alias("recall"), F.sum("hits").alias("hits"), F.count("*").alias("n_queries"))


def list_stats(assigned: DataFrame) -> DataFrame:
    """Balance of inverted lists: how many aren't empty, and the sizes' extremes and mean."""
    sizes = assigned.groupBy("cid").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("lists"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.avg("n").alias("mean"))


def batch_stats(probes: DataFrame, assigned: DataFrame, batch: int) -> DataFrame:
    """For batches of ``batch`` consecutive queries: touched lists, valid (query, row) pairs, distinct rows."""
    sizes = assigned.groupBy("cid").agg(F.count("*").alias("n"))
    rows = probes.select((F.col("qid") / batch).cast("long").alias("batch"), "qid", "cid").join(sizes, "cid")
    pairs = rows.groupBy("batch").agg(F.sum("n").alias("pairs"), F.countDistinct("qid").alias("n_queries"))
    union = rows.select("batch", "cid", "n").distinct().groupBy("batch").agg(F.count("*").alias("lists"), F.sum("n").alias("union_rows"))
    return pairs.join(union, "batch")


def sweep(configs: Iterable[tuple], run: Callable[..., DataFrame]) -> DataFrame:
    """The union of ``run(*config)`` over all configurations; ``run`` labels its rows."""
    out = None
    for config in configs:
        rows = run(*config)
        out = rows if out is None else out.unionByName(rows)
    return out


def least_ef(efs: Iterable[int], recall_of: Callable[[int], float], threshold: float) -> tuple[int, float] | None:
    """The first ef whose recall reaches the threshold, with that recall."""
    for ef in efs:
        if (r := recall_of(ef)) >= threshold:
            return ef, r
    return None


def write_metrics(rows: DataFrame, path: str) -> None:
    """A table of figures as CSV with a header; figures are few rows, so they are one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
