"""Byte-pair encoding and decoding by a pair occurrence index.

A partition's texts are taken in rounds of bounded size. The distinct pieces of a round that aren't
known yet lie end to end in one symbol list. A map holds for each adjacent pair all the positions
where it stands, and a heap holds the ranks of the pairs that occur. Ranks are applied in ascending
order, each at all its positions at once; a merge adds the positions of the pairs that it forms to
their lists, and positions that a merge has outdated are found so when their own rank comes up.

Texts are normalised and cut into pieces by the tokenizer file's own normaliser and pre-tokenizer, as
the tokenizers library runs them. Special tokens are looked for in the raw text, before that, and
travel as integers, so no text can turn into one on its way.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import slices, tidy

#: White space of other kinds, and what special tokens may begin with: such chunks are normalised one by one.
ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000<]")
#: Chunks that the library takes in one go.
AT_ONCE = 4_096
#: Characters of distinct chunks that a worker keeps; beyond, it starts anew.
KEPT_CHARS = 2_000_000
#: Bytes of text whose distinct pieces share one pair index.
INDEX_BYTES = 1_500_000


@contextmanager
def no_cycles() -> Iterator[None]:
    """Makes many tuples without looks for cycles among them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Known:
    """Ids of strings that are known, end to end in one array."""

    def __init__(self) -> None:
        self.place: dict[str | int, int] = {}
        self.ids, self.sizes = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)

    def add(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(keys, range(len(self.place), len(self.place) + len(keys)), strict=True))
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))

    def places(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, keys), dtype=np.int64, count=len(keys))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places one after the other, and where each place's begin, with the end of the last."""
        size = self.sizes[at]
        cuts = np.concatenate(([0], np.cumsum(size)))
        begin = (np.cumsum(self.sizes) - self.sizes)[at]
        return self.ids[np.repeat(begin - cuts[:-1], size) + np.arange(cuts[-1])], cuts


class ChunkMemo:
    """Remembers the ids of chunks between ASCII white space, which no normaliser step joins and no token holds.

    So a text's ids are those of its chunks one after the other. Arrow cuts texts and finds the distinct
    chunks, numpy lays their ids out; only distinct chunks become Python strings.
    """

    #: Characters of distinct chunks that are kept; beyond, it starts anew.
    kept_chars = KEPT_CHARS

    def __init__(self) -> None:
        self.forget()

    def learn(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """New chunks in an order of its own, their ids, and how many each has."""
        raise NotImplementedError

    def forget(self) -> None:
        self.known, self.kept = Known(), 0

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as 32-bit integers, and where each text's begin, with the end of the last."""
        if self.kept > self.kept_chars:
            self.forget()
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        words = chunks.dictionary.to_pylist()
        new = [w for w in words if w not in self.known.place]
        if new:
            with no_cycles():
                self.known.add(*self.learn(new))
            self.kept += sum(map(len, new))
        ids, cuts = self.known.take(self.known.places(words)[np.asarray(chunks.indices)])
        places = np.asarray(lists.offsets, dtype=np.int64)
        return ids, cuts[places - places[0]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        ids, cuts = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class PairIndexBPE(ChunkMemo):
    """Encodes all new pieces of a round through one pair occurrence index.

    Takes files whose pre-tokenizer drops white space and whose special tokens are taken as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that aren't taken as they stand")
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        if [p for p, _ in self.cut(self.normalize("a a\ta"))] != 3 * [p for p, _ in self.cut(self.normalize("a"))]:
            raise ValueError(f"{path} keeps white space in its pieces")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        model = spec["model"]
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        #: By rank: left, right and merged token; and the ranks by sorted pair.
        self.rank_pairs: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_pairs.append((vocab[left], vocab[right], vocab[left + right]))
        self.n_ranks = len(self.rank_pairs)
        keys = np.array([left << 32 | right for left, right, _ in self.rank_pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, self.n_ranks)
        letters = byte_letters()
        self.byte_of = str.maketrans({x: chr(b) for b, x in enumerate(letters)} | {"\n": "\xff"})  # a line end is no byte letter
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + self.end] for x in letters], dtype=np.int64)
        self.token_texts = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.string())
        super().__init__()

    def pieces(self, chunk: str) -> list[str | int]:
        """A raw chunk's pieces in byte letters; a special token is its id."""
        if self.special_pattern is None or "<" not in chunk and not self.special_pattern.search(chunk):
            return [p for p, _ in self.cut(self.normalize(chunk))]
        out: list[str | int] = []
        for i, part in enumerate(self.special_pattern.split(chunk)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out += [p for p, _ in self.cut(self.normalize(part))]
        return out

    def forget(self) -> None:
        super().forget()
        #: Pieces, and special tokens under their ids.
        self.known_pieces = Known()
        special = np.array(sorted(self.special.values()), dtype=np.int32)
        self.known_pieces.add(special.tolist(), special, np.ones(len(special), dtype=np.int64))

    def all_pieces(self, chunks: list[str]) -> tuple[list[str], list[str | int], np.ndarray]:
        """Chunks in an order of its own, the pieces of all, and how many each has; most chunks are normalised
        and cut many at once, a blank between them."""
        odd = [c for c in chunks if ODD.search(c)]
        plain = [c for c in chunks if not ODD.search(c)] if odd else chunks
        order, pieces, counts = [], [], []
        for at in range(0, len(plain), AT_ONCE):
            batch = plain[at : at + AT_ONCE]
            whole = self.normalize(" ".join(batch))
            lengths = np.array(list(map(len, whole.split(" "))))
            if len(lengths) != len(batch):
                odd += batch
                continue
            found = self.cut(whole)
            starts = np.fromiter(chain.from_iterable(place for _, place in found), dtype=np.int64, count=2 * len(found))[::2]
            counts.append(np.diff(np.searchsorted(starts, np.cumsum(lengths + 1)), prepend=0))
            order += batch
            pieces += [p for p, _ in found]
        own = [self.pieces(c) for c in odd]
        counts.append(np.array(list(map(len, own)), dtype=np.int64))
        return order + odd, pieces + list(chain.from_iterable(own)), np.concatenate(counts)

    def learn(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        order, pieces, counts = self.all_pieces(chunks)
        if unknown := list(set(pieces).difference(self.known_pieces.place)):
            self.known_pieces.add(unknown, *self.learn_pieces(unknown))
        ids, cuts = self.known_pieces.take(self.known_pieces.places(pieces))
        return order, ids, np.diff(cuts[np.concatenate(([0], np.cumsum(counts)))])

    def decode(self, ids: Iterable[int]) -> str:
        """The file has no decoder, so tokens are joined by a space; special ones stay."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_array(self, lists: pa.ListArray) -> pa.Array:
        """The same of each list of ids."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.token_texts.take(lists.values)), " ")

    def learn_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces one after the other, and how many each has."""
        # No byte of UTF-8 is 0xFF: it ends each piece, and no pair reaches over it.
        data = np.frombuffer("\n".join([*pieces, ""]).translate(self.byte_of).encode("latin-1"), dtype=np.uint8)
        ends = np.flatnonzero(data == 0xFF)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        symbols[ends] = -1
        self._merge(symbols)
        left = symbols >= 0
        return symbols[left].astype(np.int32), np.diff(np.cumsum(left)[ends], prepend=0)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; no rank is the number of ranks."""
        keys = (left << 32) | right
        at = np.searchsorted(self.keys, keys)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.key_ranks[at], self.n_ranks)

    def _merge(self, symbols: np.ndarray) -> None:
        """Applies all merges in place; a position that a merge swallows gets -2."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def post(ranks: np.ndarray, places: np.ndarray) -> None:
            """Adds the positions to the list of their pair."""
            if not len(ranks):
                return
            if len(ranks) > 1:
                order = np.argsort(ranks, kind="stable")
                ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(active, rank)

        first = self._ranks(symbols[:-1], symbols[1:])
        hit = np.flatnonzero(first < self.n_ranks)
        post(first[hit], hit)
        while active:
            rank = heapq.heappop(active)
            left, right, new = self.rank_pairs[rank]
            lists = index.pop(rank)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            nxt = after[places]
            fits = (symbols[places] == left) & (symbols[nxt] == right)  # else an earlier merge took one of them
            places, nxt = places[fits], nxt[fits]
            if left == right and len(places) > 1:  # in a run of one symbol, pairs from its left on
                free, taken = [], -1
                for i, (a, b) in enumerate(zip(places.tolist(), nxt.tolist(), strict=True)):
                    if a != taken:
                        free.append(i)
                        taken = b
                places, nxt = places[free], nxt[free]
            if not len(places):
                continue
            symbols[places], symbols[nxt] = new, -2
            follow, prior = after[nxt], before[places]  # each piece ends with a -1, so there is a next one
            after[places], before[follow] = follow, places
            ranks = self._ranks(np.concatenate((symbols[places], symbols[prior])), np.concatenate((symbols[follow], symbols[places])))
            hit = np.flatnonzero(ranks < self.n_ranks)
            post(ranks[hit], np.concatenate((places, prior))[hit])


@lru_cache(maxsize=2)
def model(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids array<int>, decoded string), one row for each row of ``docs``.

    Null and empty texts have no ids and decode to ''. Repeated rows and null ids are kept as
    they are; other columns of ``docs`` are never read, so their names can't clash. Texts of any
    length are encoded whole, a longer one than INDEX_BYTES in a round of its own; of pairs of one
    rank that overlap the leftmost is merged. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for at, texts in slices(batch, 1, INDEX_BYTES):
                ids, cuts = bpe.encode_array(texts)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists, bpe.decode_array(lists)], names=["doc_id", "token_ids", "decoded"])
        bpe.forget()

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = T.StructType(
        [
            T.StructField("doc_id", picked.schema[0].dataType),
            T.StructField("token_ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return picked.mapInArrow(tidy(run), out)
