"""Token ids as flat binary files with document offsets.

A dataset is a folder of parts, one for each range of doc_id, in ascending order:

- ``NAME.tokens``: the ids of its documents one after the other, as unsigned little-endian
  integers of 2 bytes, or of 4 where the vocabulary has larger ids than 65,535;
- ``NAME.offsets``: n + 1 unsigned 64-bit integers, where each document starts and the last ends;
- ``NAME.ids``: n signed 64-bit doc_ids, those of null ids 0;
- ``manifest.json``: the integer type and for each part its name, its documents, how many of them, the
  first ones, have a null id, its tokens, and the sums of documents and tokens over the parts before it.

Each run of a task writes under a name of its own, and the manifest names those of the runs that
counted; what others left is removed. Nothing is renamed or written over.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestar.llm.bpe import AT_ONCE, ODD, ChunkMemo
from lodestar.llm.common import slices, shuffle_partitions, tidy

#: Bytes of text that are encoded at once.
ENCODE_BYTES = 16_000_000


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class LibraryBPE(ChunkMemo):
    """The tokenizers library's whole encoding, special tokens included, of each distinct chunk.

    Many chunks are encoded in one go, a blank between them, and told apart by the bytes that their tokens
    stand for; where these don't add up to the chunks' own, each chunk is encoded alone.
    """

    kept_chars = 8_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alone = self.tokenizer.encode("a", add_special_tokens=False).ids
        if self.tokenizer.encode("a a\t\na", add_special_tokens=False).ids != 3 * alone:
            raise ValueError(f"{path} keeps white space in its tokens")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values(), default=0) < 1 << 16 else 4
        #: Bytes that each token stands for: a byte letter each, but for the mark of a word's end.
        end = self.tokenizer.model.end_of_word_suffix or ""
        self.token_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.token_bytes[i] = len(token.removesuffix(end))

    def lengths(self, chunks: list[str]) -> np.ndarray:
        """Bytes of each chunk when normalised; -1 if it has blanks then."""
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        other = [i for i, c in enumerate(chunks) if not c.isascii()]
        if other:
            parts = self.tokenizer.normalizer.normalize_str(" ".join(chunks[i] for i in other)).split(" ")
            sizes[other] = [len(p.encode()) for p in parts] if len(parts) == len(other) else -1
        return sizes

    def learn(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        odd, ids, sizes, order = [c for c in chunks if ODD.search(c)], [], [], []
        plain = [c for c in chunks if not ODD.search(c)] if odd else chunks
        for at in range(0, len(plain), AT_ONCE):
            batch = plain[at : at + AT_ONCE]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(batch)], add_special_tokens=False)[0].ids, dtype=np.int32)
            lengths, ends = self.lengths(batch), np.concatenate(([0], np.cumsum(self.token_bytes[found])))
            cuts = np.searchsorted(ends, np.cumsum(lengths))
            if (lengths < 0).any() or lengths.sum() != ends[-1] or (ends[cuts] != np.cumsum(lengths)).any():
                odd += batch
                continue
            order += batch
            ids.append(found)
            sizes.append(np.diff(cuts, prepend=0))
        alone = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        ids.append(np.array(list(chain.from_iterable(alone)), dtype=np.int32))
        sizes.append(np.array(list(map(len, alone)), dtype=np.int64))
        return order + odd, np.concatenate(ids), np.concatenate(sizes)


@lru_cache(maxsize=2)
def library(path: str) -> LibraryBPE:
    return LibraryBPE(path)


def _put(fs: pafs.FileSystem, path: str, chunks: Iterator[bytes]) -> None:
    with fs.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes every document, appends ``end_id`` and writes the dataset; returns the manifest.

    Null and empty texts have the end id alone. Documents stand in ascending doc_id order, null
    ids first, equal ids in the order of their texts; repeated rows are written once each. An
    empty table gives a manifest without parts. Ids must be integers. Texts of any length are encoded
    whole, and a batch of texts at a time is held in memory. Other columns aren't read.
    """
    spark = docs.sparkSession
    kind_of_id = docs.schema[id_col].dataType
    if not isinstance(kind_of_id, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{id_col} must be integers, not {kind_of_id.simpleString()}")
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = file_system(folder)
        bpe = library(path)
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        counts, ids, nulls = [np.zeros(1, dtype=np.int64)], [], 0

        def tokens() -> Iterator[bytes]:
            nonlocal nulls
            for batch in chain([first], batches):
                nulls += batch.column(0).null_count
                ids.append(np.asarray(pc.fill_null(batch.column(0).cast(pa.int64()), 0)))
                for _, texts in slices(batch, 1, ENCODE_BYTES):
                    own, cuts = bpe.encode_array(texts)
                    counts.append(np.diff(cuts) + 1)
                    yield np.insert(own, cuts[1:], end_id).astype(f"<u{bpe.width}").tobytes()

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        _put(fs, f"{base}/{name}.tokens", tokens())
        bpe.forget()
        offsets = np.cumsum(np.concatenate(counts))
        _put(fs, f"{base}/{name}.offsets", iter([offsets.astype("<u8").tobytes()]))
        _put(fs, f"{base}/{name}.ids", iter([np.concatenate(ids).astype("<i8").tobytes()]))
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "docs": len(offsets) - 1, "nulls": nulls, "tokens": int(offsets[-1]), "width": bpe.width}])

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    ranges = picked.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    # one row for each range: as many as there are shuffle partitions
    totals = sorted(ranges.mapInArrow(tidy(run), "part long, name string, docs long, nulls long, tokens long, width long").collect())
    manifest: dict = {"type": f"<u{totals[0]['width']}" if totals else "<u4", "parts": []}
    n_docs = n_tokens = 0
    for t in totals:
        manifest["parts"].append({"name": t["name"], "docs": t["docs"], "nulls": t["nulls"], "tokens": t["tokens"], "first_doc": n_docs, "first_token": n_tokens})
        n_docs, n_tokens = n_docs + t["docs"], n_tokens + t["tokens"]
    _put(fs, f"{base}/manifest.json", iter([json.dumps(manifest).encode()]))
    named = {t["name"] for t in totals}
    for info in fs.get_file_info(pafs.FileSelector(base)):
        if info.base_name.startswith("part-") and info.base_name.partition(".")[0] not in named:
            fs.delete_file(info.path)
    return manifest


class Flat:
    """A file of integers, mapped into memory where it is on a local or mounted disk, else read by ranges."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: str):
        self.kind, self.map, self.file = np.dtype(kind), None, None
        if isinstance(fs, pafs.LocalFileSystem):
            self.map = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, dtype=kind)
        else:
            self.file = fs.open_input_file(path)

    def __getitem__(self, place: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[place]
        self.file.seek(place.start * self.kind.itemsize)
        return np.frombuffer(self.file.read((place.stop - place.start) * self.kind.itemsize), dtype=self.kind)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start long, n_tokens long, tokens binary) of every document of a dataset.

    ``start`` counts the ids of all documents before it, ``tokens`` holds little-endian unsigned
    32-bit ids whatever the width on disk.
    """
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = manifest["type"]
    schema = T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("tokens", "binary")
    rows = [(p["name"], p["docs"], p["nulls"], p["first_token"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(rows, "name string, docs long, nulls long, first_token long")
    if len(rows) > 1:
        parts = parts.repartitionByRange(len(rows), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, n, nulls, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, offsets, ids = (Flat(fs, f"{base}/{name}.{x}", k) for x, k in (("tokens", kind), ("offsets", "<u8"), ("ids", "<i8")))
                for a in range(0, n, 1000):
                    b = min(a + 1000, n)
                    own, cuts = ids[a:b], offsets[a : b + 1].astype(np.int64)
                    data = [tokens[x:y].astype("<u4").tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=np.arange(a, b) < nulls), pa.array(first + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(data, pa.binary())], names=schema.names
                    )

    return parts.mapInArrow(tidy(run), schema)
