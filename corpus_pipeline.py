"""The corpus pipeline: five stages over documents, each written and read again by the next.

Quality rules drop what they reject, near-dedup keeps one document of each group, decontamination
drops documents that hold a benchmark window, secret scans mask what they find, and BPE encodes what
is left. All stages but the last return the columns of documents, whatever further columns there are.
Stages read whole texts of any length, and an empty table passes through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from lodestar.llm import quality_rules, secrets
from lodestar.llm.bpe import encode_decode
from lodestar.llm.common import removed, shared_dir, table, written
from lodestar.llm.decontamination import find_contamination
from lodestar.llm.near_dedup import near_duplicates
from lodestar.llm.queries import tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words of a shingle in the dedup stage; the four of operator 6's query are that query's own contract.
DEDUP_WORDS = 5
#: Ids of dropped documents that are sent to all tasks at most; more are joined by a shuffle.
SENT_IDS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules and the classifier keep, row by row: null and empty texts fail the
    rules, repeated rows are judged alike, a null doc_id makes no difference, a probability at the threshold is kept."""
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group.

    Rows with a null doc_id can't be told apart and all stay. Null and empty texts are linked with nothing and
    stay. Of rows that are the same in every column one stays; other rows of a kept doc_id stay together.
    """
    verdicts = near_duplicates(docs, width=DEDUP_WORDS).where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("lost_id")).agg(F.max("kept").alias("kept"))
    lost = written(verdicts.where(~F.col("kept")).select("lost_id"), shared_dir(spark), "lost_ids")
    lost = F.broadcast(lost) if lost.limit(SENT_IDS + 1).count() <= SENT_IDS else lost  # else all texts would be shuffled
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("kept_id"))
    repeated = written(repeated, shared_dir(spark), "repeated_ids")
    found = docs.where(F.col("doc_id").isNotNull()).join(lost, docs["doc_id"] == F.col("lost_id"), "left_anti")
    if repeated.limit(1).count():
        again = found.join(repeated, found["doc_id"] == repeated["kept_id"], "left_semi").distinct()
        found = found.join(repeated, found["doc_id"] == repeated["kept_id"], "left_anti").unionAll(again)
    return found.unionAll(docs.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs, also those without a doc_id, which go by
    their text. Null and empty texts stay; all rows of a doc_id go if one is hit."""
    key = F.coalesce(F.concat(F.lit("id:"), F.col("doc_id").cast("string")), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    keyed = docs.select(key.alias("doc_id"), "text")
    hit = find_contamination(keyed, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_key")).distinct()
    hit = written(hit, shared_dir(spark), "contaminated")
    return docs.join(hit, key == hit["hit_key"], "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span that the scan finds; n_chars, where there is one, follows a text that was masked. Null and
    empty texts stay as they are, and repeated rows are masked alike."""
    spans = _free_name("spans", docs)
    masked = secrets.scan_secrets(docs, into=spans).withColumn("text", secrets.redact(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", F.when(F.size(spans) > 0, n_chars).otherwise(F.col("n_chars")))
    return masked.drop(spans)


def _free_name(name: str, docs: DataFrame) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row that is left; null and empty texts have no tokens."""
    rows = encode_decode(docs, tokenizer_path())
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("bpe", encode),
]

#: The fitted model, MinHash and BPE can't be said in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is removed when the next one's is written."""
    folder = shared_dir(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
        if before is not None:
            removed(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
