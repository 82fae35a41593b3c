"""Graph searches whose beam is as wide as the part: every row, many queries, several parts."""

from __future__ import annotations

import numpy as np
import pytest
from lodestar.functions.distance import distance
from lodestar.operators import flat, graph
from lodestar.operators.hnsw import Documents, Graph, Nearest, Within
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def clumps():
    """40 points with 40 near copies each: neighbours of a copy are its copies, so clumps lose the links between them."""
    rng = np.random.default_rng(11)
    return np.repeat(rng.standard_normal((40, 8)), 40, axis=0)[rng.permutation(1600)] + 1e-4 * rng.standard_normal((1600, 8))


def built(data, metric="l2", M=4):
    g = Graph(8, metric, M, 12)
    for i, v in enumerate(data):
        g.add(v, i)
    g.mend()
    return g


def test_a_mended_graph_leads_from_everywhere_to_everything(clumps):
    g = built(clumps)
    want = [sorted(range(1600), key=lambda j: (float(((v - clumps[j]) ** 2).sum()), j))[:5] for v in clumps[:30]]
    assert [[x for _, x in g.search(v, 5, 1600)] for v in clumps[:30]] == want
    assert not [x for x in g.check() if "way in" in x or "too many" in x or "repeated" in x or "itself" in x]


@pytest.mark.parametrize("collector", [Nearest(1600), Within(4.0, 1600, 1600), Documents(3, {i: i // 5 for i in range(1600)}, 1600), Nearest(30)])
def test_many_queries_find_what_each_finds(clumps, collector):
    g = built(clumps, M=8)
    for label in (3, 77, 500):
        g.mark_deleted(label)
    allowed = set(range(0, 1600, 3))
    for few in (None, allowed):
        want = [g.search_until(v, collector, few) for v in clumps[:20]]
        got = g.search_many(clumps[:20], collector, few)
        assert [[x for _, x in row] for row in got] == [[x for _, x in row] for row in want]
        assert all(abs(a - b) < 1e-12 for x, y in zip(got, want, strict=True) for (a, _), (b, _) in zip(x, y, strict=True))
        assert [row[:4] for row in got] == g.search_many(clumps[:20], collector, few, 4)


def test_documents_of_several_parts_are_cut_where_one_too_many_begins(spark):
    data = np.random.default_rng(3).random((600, 8))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<double>")
    queries = base.where("id % 5 = 0").selectExpr("id qid", "vec qvec")
    docs = base.select("id", F.floor(F.col("id") / 150).alias("doc_id"))
    graphs = graph.build_graphs(graph.split_parts(base.withColumn("part", F.col("id") % 2)), 8, "l2")
    graphs = graphs.join(docs.select(F.col("id").alias("label"), "doc_id"), "label")
    found = graph.search_graphs(graphs, queries, 600, 8, "l2", rule=graph.documents_rule(2, 600))
    got = {(r["qid"], r["id"], r["rank"]) for r in graph.whole_documents(found, docs, 2).collect()}
    exact = flat.document_search(base.join(docs, "id"), queries, 2)
    assert got == {(r["qid"], r["id"], r["rank"]) for r in exact.collect()}


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_equal_vectors_are_equally_far(metric):
    """Whatever place they have in a matrix of whatever size, so that ties go by id."""
    rng = np.random.default_rng(2)
    q, v = rng.standard_normal((37, 64)), rng.standard_normal((1, 64))
    for n in (1, 2, 3, 5, 7, 9, 13, 31, 1000, 1001, 1003, 1007):
        dist = distance(metric).matrix(q, np.repeat(v, n, axis=0))
        assert dist.shape == (37, n) and (dist == dist[:, :1]).all()
