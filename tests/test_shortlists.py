"""Shortlists that are a share of the table: right to the row, and never listed."""

from __future__ import annotations

import numpy as np
import pytest

from lodestar.operators import ivf
from lodestar.operators import product_quantization as pq


@pytest.fixture(scope="module")
def repeated(spark):
    """400 rows of 100 vectors, so shortlists end among equal table scores and results among equal distances."""
    data = np.random.default_rng(5).standard_normal((100, 8)).astype(np.float32)[np.arange(400) % 100]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<float>").repartition(3)
    queries = base.where("id % 20 = 0").selectExpr("id qid", "vec qvec")
    return data.astype(np.float64), base, queries


def plain(data, book, codes, keep, cids=None, centroids=None, probed=None):
    out = {}
    for qid in range(0, len(data), 20):
        q = data[qid]
        table = np.einsum("md,mkd->mk", q.reshape(book.shape[0], -1), book.words)
        score = {}
        for i, code in codes.items():
            if probed is None or cids[i] in probed[qid]:
                score[i] = round(sum(table[m, x] for m, x in enumerate(code)) + (q @ centroids[cids[i]] if book.residual else 0), 9)
        short = sorted(score, key=lambda i: (-score[i], i))[:keep]
        out[qid] = sorted(short, key=lambda i: (round(1 - q @ data[i], 9), i))[:5]
    return out


def ids(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


def unjoined(found) -> bool:
    """No shortlist is joined with the table: that would shuffle a share of all pairs."""
    return "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keep", [37, 1000])
def test_a_residual_shortlist_is_reranked_where_it_lies(repeated, keep):
    data, base, queries = repeated
    index = ivf.build_lists(base, 4, 2)
    probes = ivf.probe(queries, index.centroids, 3)
    book = pq.train_residual_codebook(index, 4, 16, 100, 2)
    coded = pq.encode_table(index.assigned, book, index.centroids)
    found = pq.ivfpq_search(index, coded, book, queries, probes, 5, keep)
    rows = coded.collect()
    probed = {}
    for r in probes.collect():
        probed.setdefault(r["qid"], set()).add(r["cid"])
    assert ids(found) == plain(data, book, {r["id"]: r["code"] for r in rows}, keep, {r["id"]: r["cid"] for r in rows}, index.centroids, probed)
    assert unjoined(found)


@pytest.mark.parametrize("keep", [37, 1000])
def test_a_sampled_shortlist_is_reranked_where_it_lies(repeated, keep):
    data, base, queries = repeated
    book = pq.sample_codebook(base, 4, 16)
    codes = pq.encode_table(base, book)
    plainly = {r["id"]: r["code"] for r in codes.collect()}
    found = pq.pq_search(base, codes, book, queries, 5, keep)
    assert ids(found) == plain(data, book, plainly, keep) and unjoined(found)
    index = ivf.build_lists(base, 4, 2)
    every = ivf.probe(queries, index.centroids, 4)
    found = pq.ivfpq_search(index, pq.encode_table(index.assigned, book), book, queries, every, 5, keep)
    assert ids(found) == plain(data, book, plainly, keep) and unjoined(found)
