"""The recall of all searches: one after another, on lists and graphs that are built once."""

from __future__ import annotations

import numpy as np
from lodestar.operators import graph, ivf
from lodestar.operators.hnsw import Graph, Nearest
from lodestar.plans.queries import ON_LISTS, RECALLED, search_recall

SF = "/root/testdata/sf0.001"


def test_searches_run_by_themselves_on_what_is_built_once(spark, monkeypatch):
    built = {"lists": 0, "graphs": 0}

    def counted(name, run):
        def call(*args, **options):
            built[name] += 1
            return run(*args, **options)

        return call

    monkeypatch.setattr(ivf, "build_lists", counted("lists", ivf.build_lists))
    monkeypatch.setattr(graph, "build_graphs", counted("graphs", graph.build_graphs))
    found = search_recall(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FlatMapGroups" not in plan  # no search is left in the result's plan
    assert built == {"lists": 2, "graphs": 4}  # ivf_fullscan_l2build has lists of its own; two searches share graphs
    assert sorted(r["name"] for r in found.collect()) == sorted(RECALLED)
    assert ON_LISTS <= set(RECALLED)


def test_walks_of_many_queries_do_not_score_hop_by_hop():
    data = np.random.default_rng(7).standard_normal((700, 8))
    g = Graph(8, "ip", 8, 30)
    for i, v in enumerate(data):
        g.add(v, i)
    g.mend()
    want = [g.search(v, 10, 40) for v in data[:50]]
    calls, matrix = [], g._matrix
    g._matrix = lambda q, b: calls.append(len(q)) or matrix(q, b)
    got = g.search_many(data[:50], Nearest(40), None, 10)
    assert [[x for _, x in row] for row in got] == [[x for _, x in row] for row in want]
    assert sum(n == 50 for n in calls) == 1
    assert len(calls) <= 1 + 50 * 12  # besides the block, only the way down to level 0
