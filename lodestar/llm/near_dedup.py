"""Near duplicates by an inverted join of MinHash signatures' coordinates.

1. Each document gets its set of distinct word shingles, a fingerprint of the set and a signature of
   COORDINATES minima. Documents with equal sets are one class from here on.
2. Classes are posted under each coordinate-value pair. Pairs that one class alone has are skipped,
   and so are classes with fewer than MATCHES shared pairs: they can't match any other. The rest order
   their shared pairs by frequency; two classes with MATCHES or more in common have at least one of
   them among the rarest (all but MATCHES - 1) of each, so only this prefix is merged.
3. Stars: each class meets, in each posting list of its prefix, the list's first class. The pair with
   most collisions is confirmed on the full sets.
4. Short lists whose classes are not yet all in one component are merged in full.
5. Classes of longer ones, as texts on one template are, are posted again under the rarest shingles of their
   full sets: two sets that are similar enough share one among the first fifth of the larger and the first
   ninth of the smaller. What only the template gives two texts comes after these, so classes meet where they
   can be linked. A list is dropped where all classes are in one component, or all meet in another list before;
   a short list gives its pairs, a longer one is merged in tiles of bounded size, where only classes outside the
   list's main component are compared, and only links that join two components go on. So a large
   group takes one link for each copy, no rows for its pairs, and no link is lost that joins components.
   Everywhere pairs have MATCHES collisions and fitting sizes first and are confirmed on the full sets.
6. Components come from large-star and small-star steps.

A pair of similarity 0.8 has fewer than MATCHES collisions with a probability of 3e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, rounds, shared_dir, shuffle_partitions, span_hashes, tidy, written

COORDINATES, MATCHES = 32, 12
#: Words of a shingle where a caller names no other.
SHINGLE_WORDS = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
#: Classes of one posting list that are compared with as many others in one go, and the length of lists
#: whose pairs are passed on; those of longer ones are confirmed where the list lies.
TILE, SHORT_LIST = 2_048, 32
#: Counts that stand for the shingles' frequencies: they only set the order in which shingles count as rare.
FREQUENCIES = 1 << 17

_rng = np.random.default_rng(9_176)
_SLOPE = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_set(text: str, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    return np.unique(span_hashes(data, starts[: len(words) - k + 1], ends[k - 1 :]))


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> bytes:
    minima = np.array([(shingles * a + b).min() for a, b in zip(_SLOPE, _SHIFT, strict=True)], dtype=np.uint64)
    return (minima >> np.uint64(32)).astype("<u4").tobytes()


def sketch(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in rounds(batch, 1):
                sets = [shingle_set(t, width) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "fp", "sig"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n_shingles long, fp binary, sig binary")


def _postings(classes: DataFrame) -> DataFrame:
    """(key, fp): each coordinate with its value, as coordinate * 2**32 + value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                values = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
                keys = (values.astype(np.int64) | coordinate).ravel()
                fps = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), COORDINATES)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), fps], names=["key", "fp"])

    return classes.select("fp", "sig").mapInArrow(tidy(run), "key long, fp binary")


def _collisions(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, n) of those pairs of classes that have MATCHES collisions or more and fitting sizes."""
    m = lambda x: members.select(F.col("fp").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(m("a"), "a").join(m("b"), "b").where(_sizes_fit(F.col("n_a"), F.col("n_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u4").reshape(-1, COORDINATES) for k in (2, 3))
                n = (left == right).sum(axis=1)
                keep = pa.array(n >= MATCHES)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(n[n >= MATCHES], pa.int64())], names=["a", "b", "n"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a binary, b binary, n long")


def _sizes_fit(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    s = lambda x: sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"set_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                at = np.searchsorted(right, left)
                at[at == len(right)] = 0
                common = int(np.count_nonzero(right[at] == left))
                keep.append(100 * common >= SIMILARITY * (len(left) + len(right) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    both = pairs.select("a", "b").join(s("a"), "a").join(s("b"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(tidy(run), "a binary, b binary")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node that it reaches."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), folder, f"{name}-0")
    seen, step = None, 0
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("x")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen, step = state, step + 1
        # large star: a node's larger neighbours go to the least of it and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{step}")


class _List:
    """The classes of one posting list, or of two tiles of it, that meet here."""

    def __init__(self, group: tuple, held: list):
        self.key, self.low, self.high = group
        tile, self.fp, sig, n, root, *self.more = zip(*held, strict=True)
        roots = {r: i for i, r in enumerate(dict.fromkeys(root))}
        self.sigs = np.frombuffer(b"".join(sig), dtype="<u4").reshape(-1, COORDINATES)
        self.tiles, self.sizes = np.array(tile), np.array(n)
        self.comps = np.array([roots[r] for r in root])
        self.minor = self.comps != np.bincount(self.comps).argmax()

    def here(self, i: int, others: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Which of the others are to be compared with class i in this list; ``same`` are their equal coordinates."""
        raise NotImplementedError

    def facing(self) -> Iterator[tuple[int, np.ndarray]]:
        """All pairs of components but the main one with itself: each class outside it, and those that it meets."""
        every = np.arange(len(self.fp))
        if self.low == self.high:
            for i in np.flatnonzero(self.minor).tolist():
                yield i, every[~self.minor | (every > i)]
            return
        left, right = (np.flatnonzero(self.tiles == t) for t in (self.low, self.high))
        for i in left[self.minor[left]].tolist():
            yield i, right
        for i in right[self.minor[right]].tolist():
            yield i, left[~self.minor[left]]

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each class with those of other components that are of fitting size and have MATCHES collisions."""
        for i, others in self.facing():
            small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
            others = others[(self.comps[others] != self.comps[i]) & (100 * small >= SIMILARITY * large)]
            if len(others):
                same = self.sigs[others] == self.sigs[i]
                others = others[(same.sum(axis=1) >= MATCHES) & self.here(i, others, same)]
                if len(others):
                    yield i, others

    def pairs(self) -> Iterator[tuple[bytes, bytes]]:
        for i, others in self.candidates():
            for j in others.tolist():
                yield self.fp[i], self.fp[j]

    def links(self) -> Iterator[tuple[bytes, bytes]]:
        """Confirmed on the full sets, which are counted through an inverted index of the list's own; a
        link inside what is one component by then isn't given."""
        sets = [np.frombuffer(x, dtype=np.uint64) for x in self.more[-1]]
        lengths = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for i, others in self.candidates():
            others = others[self.comps[others] != self.comps[i]]
            a, b = np.searchsorted(flat, sets[i], side="left"), np.searchsorted(flat, sets[i], side="right")
            at = np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange(int((b - a).sum()))
            common = np.bincount(owner[at], minlength=len(sets))[others]
            for j in others[100 * common >= SIMILARITY * (lengths[i] + lengths[others] - common)].tolist():
                if self.comps[i] != self.comps[j]:
                    self.comps[self.comps == self.comps[j]] = self.comps[i]
                    yield self.fp[i], self.fp[j]


class _CoordinateList(_List):
    """Holds each class's mask of the coordinates in its prefix."""

    def here(self, i: int, others: np.ndarray, same: np.ndarray) -> np.ndarray:
        bits, masks = np.int64(1) << np.arange(COORDINATES, dtype=np.int64), np.array(self.more[0])
        met = (same @ bits) & masks[others] & masks[i]
        return (met & -met) == np.int64(1) << np.int64(self.key >> 32)  # the lowest that both prefixes hold


class _ShingleList(_List):
    """Holds the first open list of each class, and whether the shingle stands among the first of a smaller set."""

    def __init__(self, group: tuple, held: list):
        super().__init__(group, held)
        self.leads, self.early = np.array(self.more[0]), np.array(self.more[1])

    def here(self, i: int, others: np.ndarray, same: np.ndarray) -> np.ndarray:
        smaller = (self.early[others] & (self.sizes[others] <= self.sizes[i])) | (self.early[i] & (self.sizes[others] >= self.sizes[i]))
        before = (self.leads[others] == self.leads[i]) & (self.leads[i] != self.key)  # they meet there
        return smaller & ~before


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in the sets, by their last bits; FREQUENCIES sums reach the driver, however many sets there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCIES, dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                own = np.frombuffer(b"".join(batch.column(0).slice(a, 500).to_pylist()), dtype=np.uint64)
                total += np.bincount((own % FREQUENCIES).astype(np.int64), minlength=FREQUENCIES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = sets.select("shingles").mapInArrow(tidy(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(FREQUENCIES, dtype=np.int64)
    total[np.asarray(found.column("slot"))] = np.asarray(found.column("n"))
    return total


def _rare_shingles(sets: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """(key, fp, place, early): the shingles by which a set meets others, rarest first; ``early`` for those by which it meets larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                keys, places, early = [], [], []
                for x in part.column(1):
                    own = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                    n = len(own)
                    order = np.lexsort((own, frequencies[(own % FREQUENCIES).astype(np.int64)]))
                    length = n + (-SIMILARITY * n) // 100 + 1  # all but the least overlap with a set no larger, and one
                    keys.append(own[order[:length]].view(np.int64))
                    places.append(np.arange(length, dtype=np.int32))
                    early.append(places[-1] < n + (-2 * SIMILARITY * n) // (100 + SIMILARITY) + 1)
                rows = pa.array(np.repeat(np.arange(part.num_rows), list(map(len, keys))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column(0).take(rows), pa.array(np.concatenate(places)), pa.array(np.concatenate(early))], names=["key", "fp", "place", "early"])

    return sets.select("fp", "shingles").mapInArrow(tidy(run), "key long, fp binary, place int, early boolean")


def _by_list(rows: DataFrame, kind: type[_List], more: list[str], confirm: bool) -> DataFrame:
    """(a, b): candidates of each list, or with ``confirm`` links. Rows hold key, low, high, tile, fp, sig,
    n, root, what the kind of list holds, and then shingles; a task sees one list after the other and holds one at a time."""
    names = ["key", "low", "high", "tile", "fp", "sig", "n", "root", *more, *(["shingles"] if confirm else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def found() -> list[tuple[bytes, bytes]]:
            if len(held) < 2:
                return []
            own = kind(group, held)
            return [tuple(sorted(p)) for p in (own.links() if confirm else own.pairs())]

        def frame(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for a in range(0, batch.num_rows, 1_000):
                for row in zip(*(c.to_pylist() for c in batch.slice(a, 1_000).columns), strict=True):
                    if row[:3] != group:
                        out += found()
                        group, held = row[:3], []
                    held.append(row[3:])
            yield frame(out)
        yield frame(found())

    spread = rows.repartition(shuffle_partitions(rows.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return spread.select(*names).mapInArrow(tidy(run), "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    ``component_id`` is the least doc_id that links reach, the document itself included, and
    ``kept`` says that it is the document's own. A null text or one without words has no shingles
    and no links; equal texts and texts with equal sets are linked; repeated rows get the same
    result each; a row with a null doc_id has no links and isn't kept. An empty table gives no rows.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    sketches = written(sketch(texts, width), folder, "sketches")
    linkable = F.col("fp").isNotNull() & F.col("doc_id").isNotNull()
    filled = sketches.where(linkable)
    classes = filled.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = written(classes, folder, "classes")

    postings = _postings(classes)
    shared = postings.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1")
    prefixes = (
        postings.join(shared, "key")
        .groupBy("fp")
        .agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("pairs"))  # at most COORDINATES
        .where(F.size("pairs") >= MATCHES)
        .select("fp", F.transform(F.slice("pairs", F.lit(1), F.size("pairs") - (MATCHES - 1)), lambda p: p["key"]).alias("keys"))
    )
    mask = F.aggregate("keys", F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(k, 32).cast("int"))))
    members = written(classes.join(prefixes, "fp").select("fp", "rep", "sig", "n", "keys", mask.alias("mask")), folder, "members")

    posts = members.select(F.explode("keys").alias("key"), "fp")
    firsts = posts.groupBy("key").agg(F.min("fp").alias("first"))
    meets = posts.join(firsts, "key").where("fp != first").select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()
    stars = _collisions(meets, members).groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    stars = written(stars, folder, "stars")

    wanted = members.select(F.col("rep").alias("doc_id"), "fp")
    sets = written(_sets(texts.join(wanted, "doc_id"), width), folder, "sets")
    links = written(_confirmed(stars, sets), folder, "star_links")
    roots = components(links, folder, "star_components")

    rooted = members.join(roots, members["fp"] == roots["node"], "left").select("fp", "sig", "n", "mask", "keys", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, folder, "rooted")
    lists = rooted.select(F.explode("keys").alias("key"), "root").groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("first"), F.max("root").alias("last"))
    lists = lists.where("first != last").select("key", "size")
    lists = written(lists, folder, "open_lists")
    rows = rooted.select(F.explode("keys").alias("key"), "fp", "sig", "n", "mask", "root")
    whole = [F.lit(0).alias(x) for x in ("tile", "low", "high")]
    short = rows.join(lists.where(F.col("size") <= SHORT_LIST), "key").select("*", *whole)
    late = _by_list(short, _CoordinateList, ["mask"], confirm=False)

    wide = rows.join(lists.where(F.col("size") > SHORT_LIST), "key").select("fp").distinct()
    wide = written(rooted.select("fp", "sig", "n", "root").join(wide, "fp").join(sets, "fp"), folder, "wide")
    posts = written(_rare_shingles(wide, _frequencies(wide)).join(wide.select("fp", "root"), "fp"), folder, "rare")
    sizes = posts.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("first"), F.max("root").alias("last"), F.max("early").alias("any_early"))
    open_posts = posts.join(sizes.where("size > 1 and first != last and any_early").select("key", "size"), "key")
    leads = open_posts.groupBy("fp").agg(F.min(F.struct("place", "key")).alias("least")).select("fp", F.col("least.key").alias("lead"))
    led = written(open_posts.join(leads, "fp").select("key", "size", "fp", "lead", "early"), folder, "led")
    elsewhere = led.groupBy("key").agg(F.min("lead").alias("first"), F.max("lead").alias("last")).where("first = last and first != key").select("key")
    led = led.join(elsewhere, "key", "left_anti")
    short = led.where(F.col("size") <= SHORT_LIST).join(wide.drop("shingles"), "fp").select("*", *whole)
    late = written(late.unionByName(_by_list(short, _ShingleList, ["lead", "early"], confirm=False)).distinct(), folder, "late_pairs")
    long = led.where(F.col("size") > SHORT_LIST).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).join(wide, "fp")
    long = long.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    long = long.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    late_links = _confirmed(late, sets).unionByName(_by_list(long, _ShingleList, ["lead", "early"], confirm=True))
    roots = components(links.unionByName(late_links), folder, "components")

    # only classes of several documents or with links need another id than the document's own
    named = classes.where("copies > 1").select("fp", "rep").unionByName(classes.where("copies = 1").join(roots.select(F.col("node").alias("fp")), "fp", "left_semi").select("fp", "rep"))
    named = named.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = named.join(ids, "root").select("fp", "component_id")
    own = F.coalesce("component_id", "doc_id")
    linked = filled.select("doc_id", "n_shingles", "fp").join(found, "fp", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    empty = sketches.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(fp, shingles) of rows (doc_id, text, fp) whose text has that fingerprint, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in rounds(batch, 0):
                out = {}
                for fp, t in zip(batch.column(1).slice(at, len(texts)).to_pylist(), texts, strict=True):
                    own = shingle_set(t, width)
                    if len(own) and fingerprint(own) == fp:
                        out[fp] = own.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["fp", "shingles"])

    return rows.select("text", "fp").mapInArrow(tidy(run), "fp binary, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles"))
