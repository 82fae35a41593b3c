"""Feeding an index from a stream: each micro-batch of (id, vec) is an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.api import FlatIndex, VectorIndex


def latest(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each id: the last by ``order``, or any if the order doesn't matter."""
    if order is None:
        return rows.dropDuplicates(["id"])
    return rows.groupBy("id").agg(F.max_by("vec", order).alias("vec"))


def ingest(stream: DataFrame, index: VectorIndex | FlatIndex, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Upserts a stream into the index. A batch that is run again upserts the same rows, so each counts once."""

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.add_items(latest(batch, order))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
