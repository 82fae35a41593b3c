"""Verdicts and scores of the fitted classifiers against plain arithmetic, and windows that many items share."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from lodestar.llm import common, decontamination, nbsvm, ngrams, quality_rules
from lodestar.llm.common import table

from tests.llm import brute

FULL = (1 << 64) - 1


def mixed(x: int) -> int:
    x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & FULL
    x = ((x ^ (x >> 32)) * 0xA3B195354A39B70D) & FULL
    return x ^ (x >> 29)


def word_hash(word: bytes) -> int:
    return mixed((sum(int(common._BYTE[b]) * pow(int(common._MULTIPLIER), k, 1 << 64) for k, b in enumerate(word)) + len(word)) & FULL)


def features(text: str | None) -> Counter:
    """Places of each bucket: words, word pairs, repeats of one word, runs of three bytes."""
    raw = (text or "").encode()
    words = [w.encode() for w in brute.WORD.findall(text or "")]
    values = [word_hash(w) for w in words]
    first, second = int(ngrams._FIRST), int(ngrams._SECOND)
    found = list(values)
    found += [mixed((a * first + b * second) & FULL) for a, b in zip(values, values[1:], strict=False) if a != b]
    for times, bucket in zip((2, 3, 5, 9, 17, 33), ngrams._TWICE, strict=True):
        found += [int(bucket)] * sum(len(set(words[i : i + times])) == 1 for i in range(len(words) - times + 1))
    for i in range(len(raw) - 2):
        found.append(sum(int(ngrams._PLACE[k][raw[i + k]]) for k in range(3)) * first & FULL)
    return Counter(x >> 48 for x in found)


def logistic(margin: float, model: dict) -> float:
    return 1 / (1 + math.exp(-(model["slope"] * margin + model["intercept"])))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents"), table(spark, sf, "labels")


def test_verdict_of_quality_rules(docs):
    model = quality_rules.fit(*docs)
    texts = {r["doc_id"]: r["text"] for r in docs[0].collect()}
    got = quality_rules.apply_rules(docs[0], model).collect()
    assert len(got) == len(texts)
    for r in got:
        counts = features(texts[r["doc_id"]])
        norm = math.sqrt(sum(counts.values())) or 1.0
        p = logistic(sum(math.sqrt(n) / norm * model["weights"][b] for b, n in counts.items()) + model["weights"][-1], model)
        assert r["probability"] == pytest.approx(p, abs=1e-9)
        assert r["kept"] == (not brute.quality(texts[r["doc_id"]])[5] and p >= 0.5)
    assert {r["kept"] for r in got} == {True, False}


def test_score_of_nbsvm(docs):
    model = nbsvm.fit(*docs)
    texts = {r["doc_id"]: r["text"] for r in docs[0].collect()}
    got = nbsvm.score_texts(docs[0], model).collect()
    assert len(got) == len(texts)
    for r in got:
        found = sorted(features(texts[r["doc_id"]]))
        norm = math.sqrt(sum(model["ratios"][b] ** 2 for b in found)) + 1e-9
        p = logistic(sum(model["ratios"][b] / norm * model["weights"][b] for b in found) + model["weights"][-1], model)
        assert r["score"] == pytest.approx(p, abs=1e-9) and r["predicted"] == int(p >= 0.3)


@pytest.mark.parametrize("size", [10, 40_000, 200_000])
def test_both_ways_of_counting_buckets(size):
    found = np.random.default_rng(size).integers(0, 1 << quality_rules.BITS, size)
    at, values = quality_rules._vector(found)
    counts = Counter(found.tolist())
    assert at.tolist() == sorted(counts)
    assert np.allclose(values * math.sqrt(size), [math.sqrt(counts[b]) for b in at.tolist()])


def test_windows_that_many_items_share(spark, monkeypatch):
    shared = " ".join(f"common{k}" for k in range(10))
    items = [(k, f"{shared} own{k} and some more words that only item {k} has") for k in range(300)]
    texts = [shared, f"x {shared} y", f"{shared} own7 and", "none of these", None] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(texts, items)
    for limit in (decontamination.BLOCK_BYTES, 50_000):  # one pass, and several
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", limit)
        got = decontamination.find_contamination(docs, benchmark).collect()
        assert len(got) == len(texts)
        for r in got:
            w = want[r["doc_id"]]
            assert (r["n_words"], len(r["items"]), brute.sha(",".join(r["items"])), bool(r["spans"])) == (w[0], *w[2:5])
