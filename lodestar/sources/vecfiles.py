"""Binary vector files as a data source: ``spark.read.format("vecfile")``.

Kinds: fbin and ibin (unsigned 32-bit counts of rows and dimensions, then the rows), fvecs, ivecs and
bvecs (each row after its 32-bit dimension). Files are read in ranges of rows, one for each task, as
Arrow batches of (id, vec). A missing file, an empty header or a short file raises.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Kind: numpy type, Spark element type, bytes before all rows, bytes before each row.
KINDS = {
    "fbin": ("<f4", "float", 8, 0),
    "ibin": ("<i4", "int", 8, 0),
    "fvecs": ("<f4", "float", 0, 4),
    "ivecs": ("<i4", "int", 0, 4),
    "bvecs": ("u1", "smallint", 0, 4),
}
ROWS_AT_ONCE = 8_192


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _open(path: str):
    fs, inner = _file_system(path)
    if fs.get_file_info(inner).type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return fs.open_input_file(inner)


def read_shape(path: str, kind: str) -> tuple[int, int]:
    """(rows, dimensions), checked against the file's size."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS)}")
    dtype, _, head, prefix = KINDS[kind]
    width = np.dtype(dtype).itemsize
    with _open(path) as f:
        size = f.size()
        if head:
            if size < head:
                raise ValueError(f"{path} is too short for a header")
            n, d = struct.unpack("<II", f.read(8))
            if not n or not d:
                raise ValueError(f"{path} has an empty header")
            if size < head + n * d * width:
                raise ValueError(f"{path} is shorter than its header says")
            return n, d
        if size < prefix:
            raise ValueError(f"{path} is too short for a row")
        (d,) = struct.unpack("<i", f.read(4))
        stride = prefix + d * width
        if d <= 0 or size % stride:
            raise ValueError(f"{path} isn't made of rows of one dimension")
        return size // stride, d


@dataclass
class RowRange(InputPartition):
    start: int
    stop: int


class VecFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind") or options["path"].rsplit(".", 1)[-1]
        self.rows_each = int(options.get("rowsperpartition", 1_000_000))
        self.n, self.d = read_shape(self.path, self.kind)
        self.n = min(self.n, int(options.get("rows", self.n)))

    def partitions(self) -> list[RowRange]:
        return [RowRange(a, min(a + self.rows_each, self.n)) for a in range(0, self.n, self.rows_each)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        dtype, element, head, prefix = KINDS[self.kind]
        width = np.dtype(dtype).itemsize
        stride = prefix + self.d * width
        with _open(self.path) as f:
            for a in range(partition.start, partition.stop, ROWS_AT_ONCE):
                b = min(a + ROWS_AT_ONCE, partition.stop)
                f.seek(head + a * stride)
                raw = np.frombuffer(f.read((b - a) * stride), dtype=np.uint8).reshape(b - a, stride)
                rows = np.ascontiguousarray(raw[:, prefix:]).view(dtype)
                if element == "smallint":
                    rows = rows.astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * self.d), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b), pa.int64()), lists], names=["id", "vec"])


class VecFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecfile"

    def schema(self) -> str:
        kind = self.options.get("kind") or self.options["path"].rsplit(".", 1)[-1]
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS)}")
        return f"id long, vec array<{KINDS[kind][1]}>"

    def reader(self, schema) -> VecFileReader:
        return VecFileReader({k.lower(): v for k, v in self.options.items()})


def read_vectors(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(VecFileSource)
    read = spark.read.format("vecfile").option("path", path)
    if kind:
        read = read.option("kind", kind)
    return read.options(**{k: str(v) for k, v in options.items()}).load()


def write_fbin(df: DataFrame, path: str) -> tuple[int, int]:
    """Writes (id, vec) in order of id as one file, streamed through the driver; returns rows and dimensions."""
    size = F.size("vec")
    n, d, least = df.agg(F.count("vec"), F.max(size), F.min(size)).first()
    if d != least:
        raise ValueError("all rows must have one dimension")
    fs, inner = _file_system(path)
    fs.create_dir(inner.rpartition("/")[0] or ".", recursive=True)
    with fs.open_output_stream(inner) as f:
        f.write(struct.pack("<II", n, d or 0))
        for r in df.select("id", "vec").where(F.col("vec").isNotNull()).orderBy("id").toLocalIterator():
            f.write(np.array(r["vec"], dtype="<f4").tobytes())
    return n, d or 0


def from_numpy(spark: SparkSession, data: np.ndarray, ids=None, first_id: int = 0) -> DataFrame:
    """A one- or two-dimensional array as (id, vec), ids counting up if none are given."""
    rows = np.atleast_2d(np.asarray(data, dtype=np.float32))
    own = np.arange(first_id, first_id + len(rows)) if ids is None else np.atleast_1d(np.asarray(ids))
    if len(own) != len(rows):
        raise ValueError("as many ids as rows are needed")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
    return spark.createDataFrame(pa.table({"id": pa.array(own, pa.int64()), "vec": lists}))


def with_labels(result: DataFrame, labels: DataFrame) -> DataFrame:
    """Search results with the outside label of each id, from a table (id, ext_label)."""
    return result.join(labels.select("id", "ext_label"), "id", "left")
