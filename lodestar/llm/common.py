"""Shared pieces: tables, the shared folder, batching of texts and hashing of words in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one round of a Python operator holds as Python objects.
ROUND_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the driver and all executors share.

    ``spark.checkpoint.dir`` names it; where that is unset a temporary folder is taken and set, but only
    in a session without executors of its own. On a cluster it raises, as executors wouldn't see that folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lodestar-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later step reads, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, read back."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, limit: int = ROUND_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive slices with about ``limit`` bytes of text each, one row at least; null is ''."""
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def rounds(batch: pa.RecordBatch, column: int, limit: int = ROUND_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The same as Python strings."""
    for at, texts in slices(batch, column, limit):
        yield at, texts.to_pylist()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives memory back when it ends: the worker stays for other operators' tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
        if trim is not None:
            trim(0)

    return tidied


# ------------------------------------------------------------------ words as hashes

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
#: A random 64-bit value for each byte.
_BYTE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        steps = np.full(size, _MULTIPLIER if kind == "up" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        got = _powers[kind] = np.multiply.accumulate(steps)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a finaliser of multiply and xor-shift steps)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("up", n + 1)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``separator[byte]`` doesn't mark."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separator[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


#: Bytes that end a word of ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z in UTF-8 bytes and leaves all others.
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))

#: The same, and turns each byte outside a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` into a space.
PLAIN = bytes(x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 0x20 for x in LOWER)
