"""Every query over its whole tables against a plain version."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from lodestar.llm.queries import QUERIES, tokenizer_path

from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def rows(spark, sf, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}


def test_licenses(spark, sf, docs):
    got = rows(spark, sf, "op1_licenses")
    assert len(got) == len(docs)
    for i, text in docs:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_bpe(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = rows(spark, sf, "op2_bpe")
    assert len(got) == len(docs)
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[i]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == brute.sha(t.decode(ids, skip_special_tokens=False))


def test_sharding(spark, sf, docs):
    got = rows(spark, sf, "op3_sharding")
    total, done, slots = sum(len((t or "").encode()) + 1 for _, t in docs), 0, [0] * 16
    for i, text in docs:
        r, size = got[i], len((text or "").encode()) + 1
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (size, brute.crc(text), "bytes", None)
        assert r["shard"] == min(15, 16 * (2 * done + size) // (2 * total)) and r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        done += size


def test_token_files(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got, start = rows(spark, sf, "op4_token_files"), 0
    assert len(got) == len(docs)
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_decontamination(spark, sf, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows(spark, sf, "op5_decontamination")
    want = brute.contamination([t for _, t in docs], items)
    assert any(w[4] for w in want)
    assert [tuple(got[i][1:]) for i, _ in docs] == want


def test_near_dedup(spark, sf, docs):
    got, want = rows(spark, sf, "op6_near_dedup"), brute.near(docs, 4)
    assert {i: tuple(r[1:]) for i, r in got.items()} == want


def test_secrets(spark, sf, docs):
    got = rows(spark, sf, "op7_secrets")
    for i, text in docs:
        assert tuple(got[i][1:5]) == brute.secrets(text)
        assert sum(not x.startswith("entropy") for x in got[i]["spans"].split(",") if x) == sum(got[i][1:4])


def test_quality_rules(spark, sf, docs):
    got = rows(spark, sf, "op8_quality_rules")
    for i, text in docs:
        assert tuple(got[i][1:7]) == brute.quality(text)
        assert not (got[i]["base_failed"] and got[i]["kept"])


@pytest.mark.parametrize(("name", "label", "least"), [("op9_toxicity", "toxic", 0.5), ("op10_nbsvm", "quality", 0.3)])
def test_classifiers(spark, sf, docs, name, label, least):
    got = rows(spark, sf, name)
    assert got.keys() == {i for i, _ in docs}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [(labels[i], r["predicted"]) for i, r in got.items() if i in labels]
    assert np.mean([a == b for a, b in known]) > 0.85
