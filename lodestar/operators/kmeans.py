"""Lloyd's k-means with the variants that the indexes need.

Centroids (nlist x d numbers, checked) go out with the tasks; each batch is assigned by a matrix
product and summed by cluster before anything is shuffled, so an iteration moves nlist x d numbers
for each partition, never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.scan import matrix

#: Numbers in all centroids at most: they are held by the driver and every task.
CENTROID_NUMBERS = 50_000_000
#: The stride of initial rows, and the constants of reseeding empty clusters.
SEED_STRIDE, RESEED_STEP, RESEED_CLUSTER = 9973, 1315423911, 2654435761


def _nearest(rows: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """The cluster of each row; of equal ones the lowest."""
    if metric == "ip":
        return np.argmax(rows @ centroids.T, axis=1)
    gaps = (centroids * centroids).sum(axis=1) - 2 * rows @ centroids.T
    best = np.argmin(gaps, axis=1)
    # the short form only picks candidates: where two are close, differences decide
    close = gaps <= gaps[np.arange(len(rows)), best][:, None] + 1e-9 * (1 + (rows * rows).sum(axis=1))[:, None]
    for i in np.flatnonzero(close.sum(axis=1) > 1):
        options = np.flatnonzero(close[i])
        best[i] = options[np.argmin(((rows[i] - centroids[options]) ** 2).sum(axis=1))]
    return best


def take_rows(base: DataFrame, wanted: list[int]) -> dict[int, np.ndarray]:
    """Vectors by id of a bounded list of ids; an id that the table lacks is simply absent."""
    rows = base.where(F.col("id").isin([int(x) for x in set(wanted)])).select("id", "vec").collect()
    return {r["id"]: np.array(r["vec"], dtype=np.float64) for r in rows}


def initial_centroids(base: DataFrame, n: int, nlist: int) -> np.ndarray:
    """Row (c * 9973) mod n for cluster c; where ids aren't 0 to n - 1, the rows of the least hashes."""
    wanted = [(c * SEED_STRIDE) % n for c in range(nlist)]
    have = take_rows(base, wanted)
    if len(have) == len(set(wanted)):
        return np.array([have[i] for i in wanted])
    rows = base.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(nlist).collect()
    return np.array([rows[c % len(rows)]["vec"] for c in range(nlist)], dtype=np.float64)


def assign(base: DataFrame, centroids: np.ndarray, metric: str = "ip") -> DataFrame:
    """``base`` with a column ``cid``, without a shuffle."""
    at = base.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = _nearest(matrix(batch.column(at)).astype(np.float64), centroids, metric) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cid, pa.int64())], names=[*batch.schema.names, "cid"])

    schema = base.drop("cid").schema.add("cid", "long") if "cid" in base.columns else base.schema.add("cid", "long")
    return base.drop("cid").mapInArrow(run, schema)


def _sums(base: DataFrame, centroids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    nlist, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((nlist, d)), np.zeros(nlist, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(0)).astype(np.float64)
                cid = _nearest(rows, centroids, metric)
                np.add.at(sums, cid, rows)
                counts += np.bincount(cid, minlength=nlist)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(full, d)), pa.array(np.tile(np.arange(d), len(full))), pa.array(sums[full].ravel()), pa.array(np.repeat(counts[full], d))],
            names=["cid", "dim", "total", "n"],
        )

    parts = base.select("vec").mapInArrow(run, "cid long, dim long, total double, n long")
    sums, counts = np.zeros((nlist, d)), np.zeros(nlist, dtype=np.int64)
    for r in parts.groupBy("cid", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        sums[r["cid"], r["dim"]], counts[r["cid"]] = r["total"], r["n"]
    return sums, counts


def kmeans(base: DataFrame, nlist: int, iterations: int = 10, metric: str = "ip", empty: str = "zero", final_reassign: bool = True) -> tuple[np.ndarray, DataFrame]:
    """Centroids and ``base(id, vec, ...)`` with ``cid``.

    ``metric`` 'ip' assigns by the greatest product, 'l2' by the least squared distance. An ``empty``
    cluster becomes the 'zero' vector or, with 'reseed', the row ((iteration + 1) * 1315423911 +
    cid * 2654435761) mod n. Without ``final_reassign`` the assignment is the last iteration's, one
    update older than the centroids. Rows without a vector are left out.
    """
    if metric not in ("ip", "l2") or empty not in ("zero", "reseed"):
        raise ValueError("metric is ip or l2, empty is zero or reseed")
    base = base.where(F.col("vec").isNotNull())
    stats = base.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"), F.min(F.size("vec")).alias("least")).first()
    n = stats["n"]
    if not n or nlist <= 0 or stats["d"] != stats["least"]:
        raise ValueError("k-means needs rows of one dimension and a positive number of clusters")
    nlist = min(nlist, n)
    if nlist * stats["d"] > CENTROID_NUMBERS:
        raise ValueError(f"{nlist} centroids of {stats['d']} numbers are more than a task should hold")
    centroids = initial_centroids(base, n, nlist)
    used = centroids
    for it in range(iterations):
        used = centroids
        sums, counts = _sums(base, centroids, metric)
        centroids = sums / np.maximum(counts, 1)[:, None]
        if empty == "reseed" and (gone := np.flatnonzero(counts == 0)).size:
            wanted = {int(c): ((it + 1) * RESEED_STEP + int(c) * RESEED_CLUSTER) % n for c in gone}
            have = take_rows(base, list(wanted.values()))
            for c, i in wanted.items():
                centroids[c] = have.get(i, used[c])
    return centroids, assign(base, centroids if final_reassign else used, metric)


def partition_centroids(base: DataFrame, parts: int) -> DataFrame:
    """(part, dim, value): the mean of each part of ``base(id, vec, part)``; an empty part has row (part mod n)."""
    means = base.select("part", F.posexplode("vec").alias("dim", "x")).groupBy("part", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))
    every = base.sparkSession.range(parts).select(F.col("id").alias("part"))
    missing = every.join(base.select(F.col("part").cast("long").alias("part")).distinct(), "part", "left_anti")
    n = base.count()
    fill = missing.join(base.select(F.col("id").alias("row"), "vec"), F.col("row") == F.col("part") % F.lit(max(n, 1)))
    filled = fill.select("part", F.posexplode("vec").alias("dim", "x")).select("part", "dim", F.col("x").cast("double").alias("value"))
    return means.select(F.col("part").cast("long").alias("part"), "dim", "value").unionByName(filled)
