"""The queries of this subpackage: thin, each takes its rows from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import nbsvm, quality_rules, secrets, toxicity
from lodestar.llm.bpe import encode_decode
from lodestar.llm.common import shared_dir, table
from lodestar.llm.decontamination import covered_words, find_contamination
from lodestar.llm.licenses import scan_licenses
from lodestar.llm.near_dedup import near_duplicates
from lodestar.llm.shards import shard_by_bytes
from lodestar.llm.token_files import read_token_files, write_token_files


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    names = lambda matches: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return rows.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens"
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=1)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        covered_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["order"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["order"] < 3)
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("secret_spans")).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, model)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = toxicity.count_trigrams(docs)
    return toxicity.score_texts(docs, counts, toxicity.fit(docs, table(spark, sf_dir, "labels"), counts))


def op10_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score_texts(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_token_files": op4_token_files,
    "op5_decontamination": op5_decontamination,
    "op6_near_dedup": op6_near_dedup,
    "op7_secrets": op7_secrets,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_nbsvm": op10_nbsvm,
}
