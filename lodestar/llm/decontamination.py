"""Benchmark decontamination in DataFrame functions alone: a prefix-filtered join of shingles.

An item's windows (10 consecutive words, or the whole of a shorter item) are sets of shingles of 3
consecutive words. All documents are counted once, so each window's shingles can be ordered by
rarity. A document contains a window only if it contains all its shingles, so the necessary prefix
is one shingle, the rarest. Documents' shingles join these, the length and position bounds of
window and document are applied, and what is left is verified word by word.

The windows are broadcast in blocks of about BLOCK_WINDOWS and BLOCK_BYTES at most; a larger benchmark
takes one pass over the documents for each block. What is shuffled is one small row for each document.
Which items have a window stays out of the broadcast, as thousands may share one: the ids of a
document's windows join them afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import shared_dir, written

WINDOW, SHINGLE = 10, 3
#: Windows that are broadcast at once, and bytes of their words.
BLOCK_WINDOWS, BLOCK_BYTES = 100_000, 32 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """Lower-cases A-Z and takes words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lower, BETWEEN), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.get(words, at + k) for k in range(width)))


def _item_windows(items: DataFrame) -> DataFrame:
    """(wid, window, item): a row for each window of each item."""
    words = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("words"))
    size = F.least(F.lit(WINDOW), F.size("words"))
    starts = words.where(F.size("words") > 0).select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("start"))
    windows = starts.select("item", F.slice("words", F.col("start"), F.col("size")).alias("window"))
    return windows.select(F.md5(F.array_join("window", " ").cast("binary")).alias("wid"), "window", "item")


def _window_shingles(windows: DataFrame, width: int) -> DataFrame:
    mine = windows.where(F.least(F.lit(SHINGLE), F.size("window")) == width)
    return mine.select("wid", F.explode(F.sequence(F.lit(0), F.size("window") - width)).alias("offset"), "window").select(
        "wid", "offset", _shingle(F.col("window"), F.col("offset"), width).alias("shingle")
    )


def _document_shingles(words: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each place of a document and width, and one at place -1 for the document itself."""
    placed = words.select("*", F.size("words").alias("n_words"), F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    keys = [F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(_shingle(F.col("words"), F.col("at"), w)) for w in widths]
    return placed.withColumn("shingle", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items): one row for each row of ``docs``.

    ``spans`` are the (start, end) of all occurrences of windows, in words from 0, end exclusive;
    ``items`` the distinct ids, as sorted strings, of the items with occurring windows. Null and
    empty texts have no words and no spans, and so have items without words or id; repeated rows
    stay apart, and of items with the same text each is named. Other columns aren't read.
    """
    found, folder = None, shared_dir(docs.sparkSession)
    owners = _item_windows(items)
    windows = owners.select("wid", "window").distinct()
    widths = windows.groupBy(F.least(F.lit(SHINGLE), F.size("window")).alias("width"))
    sizes = widths.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("window", " "))).alias("bytes")).collect()
    blocks = max(1, -(-sum(r["n"] for r in sizes) // BLOCK_WINDOWS), -(-sum(r["bytes"] for r in sizes) // BLOCK_BYTES))
    widths = sorted(r["width"] for r in sizes) or [SHINGLE]
    # the row number keeps repeated doc_ids apart
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if blocks > 1:  # all passes must see the same numbers
        rows = written(rows, folder, "rows")
    words = rows.select("row", "doc_id", plain_words(F.col("text")).alias("words"))
    for block in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == block)
        shingles = reduce(DataFrame.union, (_window_shingles(mine, w) for w in widths))
        vocabulary = F.broadcast(shingles.select("shingle").distinct())
        # written, as a broadcast must not wait for a pass over all documents
        counts = _document_shingles(words.select("words"), widths).join(vocabulary, "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
        counts = written(counts, folder, f"counts-{block}")
        ordered = shingles.join(F.broadcast(counts), "shingle", "left").groupBy("wid").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
        )
        prefix = mine.join(ordered, "wid").select(
            F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset"), "window", "wid"
        )
        itself = docs.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("shingle"),
            F.lit(-1).alias("offset"),
            F.array().cast("array<string>").alias("window"),
            F.lit(None).cast("string").alias("wid"),
        )
        placed = _document_shingles(words, widths).join(F.broadcast(prefix.union(itself)), "shingle")
        start = F.col("at") - F.col("offset")
        size = F.size("window")
        fits = (F.col("at") >= 0) & (size > 0) & (start >= 0) & (start + size <= F.col("n_words"))
        stands = F.when(fits, F.slice("words", start + 1, size) == F.col("window")).otherwise(F.lit(False))
        hits = placed.where(stands | ((F.col("at") < 0) & (size == 0))).select(
            "row", "doc_id", "n_words", F.when(size > 0, F.struct(start.alias("start"), (start + size).alias("end"))).alias("span"), "wid"
        )
        found = hits if found is None else found.union(hits)
    found = found.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("wid").alias("wids"))
    found = written(found, folder, "found")
    named = found.select("row", F.explode("wids").alias("wid")).join(owners.select("wid", "item").distinct(), "wid")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.join(named, "row", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.array_sort("spans").alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered_words(spans: Column) -> Column:
    """Number of words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
