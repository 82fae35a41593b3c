"""Sharding by bytes: contiguous shards of near equal size from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import shared_dir, shuffle_partitions, tidy, written


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): each shard is a run of documents in doc_id order.

    Ranges of doc_id are sorted, each task adds up its own range, and the ranges' totals give
    the global byte position of each document. The document whose middle byte lies in the k-th
    of ``n_shards`` equal targets goes to shard k, so a shard is off its target by at most the
    half of a document at either end. Only (id, size, crc) are shuffled, never texts, and the
    driver sees one total for each range.

    A null text has size 1 and the crc of nothing. Null ids come first, equal ids stand in order
    of crc and size, so repeated rows get slots of their own. Copies of a text may go to different
    shards. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    data = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(
        docs[id_col].alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    order = ("doc_id", "text_crc32", "size")
    schema = T.StructType(
        rows.schema.fields + [T.StructField(x, T.LongType()) for x in ("range", "row_in_range", "bytes_before")]
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = np.asarray(batch.column(1))
            ends = before + np.cumsum(sizes)
            n = len(sizes)
            more = np.full(n, part), np.arange(row, row + n), ends - sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], names=schema.names)
            row, before = row + n, int(ends[-1]) if n else before

    ranges = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    summed = written(ranges.mapInArrow(tidy(add_up), schema), shared_dir(spark), "ranges")
    # one row for each range: as many as there are shuffle partitions
    totals = summed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("range").collect()
    bases, row, done = [], 0, 0
    for t in totals:
        bases.append((t["range"], row, done))
        row, done = row + t["n"], done + t["bytes"]
    base = spark.createDataFrame(bases, "range long, base_row long, base_bytes long")
    middle_twice = 2 * (F.col("base_bytes") + F.col("bytes_before")) + F.col("size")
    shard = F.floor(middle_twice.cast("decimal(20,0)") * n_shards / F.lit(2 * max(done, 1)).cast("decimal(20,0)"))
    placed = summed.join(F.broadcast(base), "range").select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(n_shards - 1), shard).cast("int").alias("shard"),
        (F.col("base_row") + F.col("row_in_range")).alias("row"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )
