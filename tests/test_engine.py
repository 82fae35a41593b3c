"""The engine's parts on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from lodestar.api import FlatIndex, LazyIndex, VectorIndex
from lodestar.operators import evaluate, flat, graph, ivf, kmeans, partition
from lodestar.operators import product_quantization as pq
from lodestar.operators import scalar_quantization as sq
from lodestar.operators.hnsw import Documents, Graph, Nearest, Within
from lodestar.sources.vecfiles import from_numpy, read_vectors, write_fbin
from pyspark.sql import functions as F

FIVE = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1]], dtype=np.float32)


def table(spark, data, ids=None):
    return from_numpy(spark, data, ids).cache()


def as_queries(base):
    return base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


@pytest.fixture(scope="module")
def points(spark):
    data = np.random.default_rng(5).random((600, 8), dtype=np.float32)
    return data, table(spark, data)


def ids_of(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["id"])
    return out


@pytest.mark.parametrize("engine", ["arrow", "sql"])
@pytest.mark.parametrize(("metric", "want"), [("l2", [0, 1, 2, 2, 2]), ("ip", [-2, -1, 0, 0, 0]), ("cosine", [0, 0.1835, 0.423, 0.423, 0.423])])
def test_metric_constants(spark, metric, want, engine):
    base = table(spark, FIVE)
    got = flat.flat_topk(base, as_queries(base).where("qid = 4"), 5, metric, engine=engine).orderBy("rank").collect()
    assert np.allclose([r["dist"] for r in got], want, atol=1e-3)


def test_ties_stand_by_id_and_engines_agree(spark, points):
    same = table(spark, np.ones((9, 4), dtype=np.float32), [8, 7, 6, 5, 4, 3, 2, 1, 0])
    for engine in ("arrow", "sql"):
        assert ids_of(flat.flat_topk(same, as_queries(same).where("qid = 3"), 4, "l2", engine=engine)) == {3: [0, 1, 2, 3]}
    base = points[1]
    queries = as_queries(base).where("qid < 7")
    for metric in ("ip", "l2", "cosine"):
        assert ids_of(flat.flat_topk(base, queries, 6, metric, block=3)) == ids_of(flat.flat_topk(base, queries, 6, metric, engine="sql"))


def test_filter_epsilon_and_strict(spark, points):
    data, base = points
    queries = as_queries(base).where("qid < 5")
    got = ids_of(flat.flat_topk(base, queries, 4, "l2", where=F.col("id") % 3 == 0))
    dist = ((data[:5, None] - data[None]) ** 2).sum(2)
    assert got == {i: sorted(range(0, 600, 3), key=lambda j: (dist[i, j], j))[:4] for i in range(5)}
    near = flat.epsilon_search(base, queries, 0.2, 500)
    assert {i: set(x) for i, x in ids_of(near).items()} == {i: set(np.flatnonzero(dist[i] <= 0.2).tolist()) for i in range(5)}
    with pytest.raises(ValueError, match="fewer than 4"):
        flat.require_k(flat.flat_topk(base, queries, 4, where=F.col("id") < 2), queries, 4)
    assert flat.flat_topk(base.where("id < 0"), queries, 3).count() == 0
    assert flat.flat_topk(base, queries.where("qid < 0"), 3).count() == 0


def test_recall_counts_queries_without_hits(spark):
    result = spark.createDataFrame([(1, 5, 1)], "qid long, id long, rank long")
    truth = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "qid long, id long, rank long")
    queries = spark.createDataFrame([(1,), (2,)], "qid long")
    got = {r["qid"]: (r["hits"], r["recall"]) for r in evaluate.recall(result, truth, queries, 2).collect()}
    assert got == {1: (1, 0.5), 2: (0, 0.0)}


def test_scalar_quantization_rounds_away_from_zero(spark):
    row = np.array([[0.5, -0.5, 2.5, -2.5, 127.5, -200, 0, 1]], dtype=np.float32)
    assert sq.encode_matrix(row, 1.0).tolist() == [[1, -1, 3, -3, 127, -128, 0, 1]]
    got = table(spark, row).select(sq.encode(F.col("vec"), 1.0).alias("c")).first()["c"]
    assert list(got) == [1, -1, 3, -3, 127, -128, 0, 1]
    assert sq.train(table(spark, np.zeros((2, 3), dtype=np.float32))) == 127.0


def test_kmeans_variants(spark):
    rng = np.random.default_rng(1)
    blobs = np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in ((5, 0), (0, 5), (-5, -5))]).astype(np.float32)
    base = table(spark, blobs)
    centroids, rows = kmeans.kmeans(base, 3, 8, "l2", "reseed")
    got = {r["id"]: r["cid"] for r in rows.collect()}
    assert centroids.shape == (3, 2) and len(got) == 120
    want = np.argmin(((blobs[:, None] - centroids[None]) ** 2).sum(2), axis=1)
    assert [got[i] for i in range(120)] == want.tolist()
    twice = table(spark, np.repeat(FIVE[:2], 3, axis=0))
    zero, _ = kmeans.kmeans(twice, 4, 1, "l2", "zero")
    assert (zero == 0).all(axis=1).sum() == 2
    with pytest.raises(ValueError):
        kmeans.kmeans(base.where("id < 0"), 3)


def test_ivf_probing_all_lists_is_exact(spark, points, tmp_path):
    _, base = points
    queries = as_queries(base).where("qid < 9")
    index = ivf.build_lists(base, 8, 3, metric="ip", empty="reseed")
    every = ivf.probe(queries, index.centroids, 99)
    want = ids_of(flat.flat_topk(base, queries, 5, "ip"))
    assert ids_of(ivf.ivf_search(index, queries, every, 5)) == want
    assert ids_of(ivf.union_search(index, queries, every, 5)) == want
    few = ivf.probe(queries, index.centroids, 2)
    assert ids_of(ivf.ivf_search(index, queries, few, 5)) == ids_of(ivf.union_search(index, queries, few, 5))
    index.save(str(tmp_path / "ivf"))
    back = ivf.InvertedLists.load(spark, str(tmp_path / "ivf"))
    assert ids_of(ivf.ivf_search(back, queries, few, 5)) == ids_of(ivf.ivf_search(index, queries, few, 5))


@pytest.mark.parametrize(("low", "high", "tau", "coverage"), [(2, 8, 0.05, 0.8), (1, 8, 1e-9, 0.5), (3, 2, 0.1, 0.0), (9, 99, 0.1, 0.99), (1, 8, 100.0, 0.6)])
def test_adaptive_probe_against_the_loop(spark, points, low, high, tau, coverage):
    data, base = points
    queries = as_queries(base).where("qid < 6")
    centroids = data[:8].astype(np.float64)
    got = {}
    for r in ivf.adaptive_probe(queries, centroids, low, high, tau, coverage).collect():
        got.setdefault(r["qid"], set()).add(r["cid"])
    least = max(1, min(low, 8))
    most = max(least, min(high, 8))
    for i in range(6):
        s = centroids @ data[i].astype(np.float64)
        order = np.argsort(-s, kind="stable")[:most]
        w = np.exp((s[order] - s[order[0]]) / max(tau, 1e-8))
        total = 0.0
        for chosen in range(1, most + 1):
            total += w[chosen - 1] / w.sum()
            if chosen >= least and total >= coverage:
                break
        assert got[i] == set(order[:chosen].tolist())


def test_product_quantization_with_a_wide_shortlist_is_exact(spark, points):
    _, base = points
    queries = as_queries(base).where("qid < 4")
    book = pq.sample_codebook(base, 4, 16)
    codes = pq.encode_table(base, book)
    want = ids_of(flat.flat_topk(base, queries, 5, "ip"))
    assert ids_of(pq.pq_search(base, codes, book, queries, 5, 600)) == want
    index = ivf.build_lists(base, 4, 2)
    every = ivf.probe(queries, index.centroids, 4)
    residual = pq.train_residual_codebook(index, 4, 16, 100, 2)
    coded = pq.encode_table(index.assigned, residual, index.centroids)
    assert ids_of(pq.ivfpq_search(index, coded, residual, queries, every, 5, 600)) == want
    for bad in ((3, 16), (0, 16), (4, 0), (4, 300)):
        with pytest.raises(ValueError):
            pq.check_shape(8, *bad)


def test_owners(spark):
    rows = spark.range(10)
    sizes = lambda n, p: [r["n"] for r in partition.part_stats(partition.with_part(spark.range(n), p, "block")).orderBy("part").collect()]
    assert sizes(10, 4) == [3, 3, 2, 2] and sizes(2, 4) == [1, 1]
    assert [r["part"] for r in partition.with_part(rows, 3, "nonsense").orderBy("id").collect()] == [i % 3 for i in range(10)]

    def mixed(x):
        for factor in (partition.FINAL_1, partition.FINAL_2):
            x = (x ^ (x >> 33)) * factor % (1 << 64)
        return x ^ (x >> 33)

    big = spark.createDataFrame([(i,) for i in (0, 1, 7, 123456789, (1 << 40) + 3)], "id long")
    assert {r["id"]: r["part"] for r in partition.with_part(big, 7, "hash").collect()} == {r["id"]: mixed(r["id"]) % 7 for r in big.collect()}


def test_graph_finds_what_exact_search_finds(points):
    data, _ = points
    g = Graph(8, "l2", 8, 60)
    for i, v in enumerate(data):
        g.add(v, i)
    dist = ((data[:20, None] - data[None]) ** 2).sum(2)
    want = [sorted(range(600), key=lambda j: (dist[i, j], j))[:10] for i in range(20)]
    assert [[x for _, x in g.search(data[i], 10, 600)] for i in range(20)] == want
    got = [{x for _, x in g.search(data[i], 10, 60)} for i in range(20)]
    assert np.mean([len(a & set(b)) / 10 for a, b in zip(got, want, strict=True)]) > 0.95
    assert all(g.search(data[i], 1)[0][1] == i for i in range(20))
    assert [x for x in g.check() if "no link" not in x] == []
    evens = set(range(0, 600, 2))
    assert all(x in evens for _, x in g.search(data[1], 10, 60, evens))
    near = g.search_until(data[0], Within(0.15, 50, 600))
    assert {x for _, x in near} == set(np.flatnonzero(dist[0] <= 0.15).tolist())
    docs = {i: i // 5 for i in range(600)}
    found = g.search_until(data[0], Documents(4, docs, 40))
    assert len({docs[x] for _, x in found}) == 4
    assert g.search_until(data[0], Nearest(3))[0][1] == 0


def test_graph_deletes_updates_and_reuses(points):
    data, _ = points
    g = Graph(8, "l2", 8, 60, max_elements=100, allow_replace_deleted=True)
    for i in range(100):
        g.add(data[i], i)
    with pytest.raises(ValueError, match="limit"):
        g.add(data[100], 100)
    g.mark_deleted(3)
    with pytest.raises(ValueError, match="already"):
        g.mark_deleted(3)
    assert 3 not in [x for _, x in g.search(data[3], 5, 50)]
    g.unmark_deleted(3)
    assert g.search(data[3], 1, 50)[0][1] == 3
    g.mark_deleted(3)
    g.add(data[300], 300, replace_deleted=True)
    assert 3 not in g.slot_of and g.search(data[300], 1, 50)[0][1] == 300 and len(g) == 100
    g.add(data[400], 7)
    assert g.search(data[400], 1, 50)[0][1] == 7
    back = Graph.of_rows(g.rows(), 8, metric="l2", M=8, ef_construction=60)
    assert all(back.search(v, 5, 50) == g.search(v, 5, 50) for v in data[:10])
    with pytest.raises(KeyError):
        g.vector(12345)


def test_graphs_of_parts(spark, points):
    _, base = points
    queries = as_queries(base).where("qid < 10")
    want = ids_of(flat.flat_topk(base, queries, 5, "ip"))
    split = graph.split_parts(partition.with_part(base, 3, "hash"), 120)
    assert split.select("part").distinct().count() > 3
    graphs = graph.build_graphs(split, 8).cache()
    assert ids_of(graph.search_graphs(graphs, queries, 5, 8, ef=600)) == want
    assert graph.broken_links(graphs).where("problem != 'no way in'").count() == 0
    parted = partition.with_part(base, 4, "block")
    chosen = graph.select_parts(parted, queries, 4, 4, 8)
    split = graph.split_parts(parted)
    every = graph.searched_parts(chosen, split)
    assert ids_of(graph.search_graphs(graph.build_graphs(split, 8), queries, 5, 8, ef=600, parts=every)) == want


def test_integrity_of_all_levels(spark):
    """Every problem of every level is named, and what a build leaves without a way in is mended."""
    rows = [("p", 0, 0, 1, False, True, [0.0], [2, 1, 2, 2, 0, 1]), ("p", 1, 1, 1, False, False, [1.0], [1, 0, 2, 0, 0]), ("p", 2, 2, 0, False, False, [2.0], [2, 2, 0]), ("p", 3, 3, 0, False, False, [3.0], [1, 0])]
    got = {(r["node"], r["problem"]) for r in graph.broken_links(spark.createDataFrame(rows, graph.SCHEMA)).collect()}
    assert got == {(0, "links to itself on level 1"), (1, "repeated link on level 1"), (2, "links to itself"), (3, "no way in")}
    data = np.random.default_rng(5).normal(size=(600, 8)) * np.linspace(0.1, 3, 600)[:, None]
    g = Graph(8, "ip", 4, 20)
    for i, v in enumerate(data):
        g.add(v, i)
    assert any("no link leads" in x for x in g.check())
    g.mend()
    assert g.check() == []
    split = graph.split_parts(table(spark, data.astype(np.float32)).withColumn("part", F.lit(0)))
    assert graph.broken_links(graph.build_graphs(split, 8, M=4, ef_construction=20)).count() == 0


def test_vector_files(spark, tmp_path):
    data = np.random.default_rng(2).random((1000, 8), dtype=np.float32)
    path = str(tmp_path / "base.fbin")
    assert write_fbin(table(spark, data), path) == (1000, 8)
    rows = read_vectors(spark, path, rowsPerPartition=300)
    assert rows.rdd.getNumPartitions() == 4
    got = {r["id"]: r["vec"] for r in rows.collect()}
    assert len(got) == 1000 and all(np.allclose(got[i], data[i]) for i in range(1000))
    raw = open(path, "rb").read()
    for name, content in (("short.fbin", raw[:-3]), ("zero.fbin", bytes(8)), ("stub.fbin", b"abc")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(Exception, match="shorter|empty|too short"):
            read_vectors(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="absent.fbin"):
        read_vectors(spark, str(tmp_path / "absent.fbin")).collect()
    bytes_rows = np.arange(12, dtype=np.uint8).reshape(3, 4) + 240
    (tmp_path / "a.bvecs").write_bytes(b"".join(np.int32(4).tobytes() + r.tobytes() for r in bytes_rows))
    assert [r["vec"] for r in read_vectors(spark, str(tmp_path / "a.bvecs")).orderBy("id").collect()] == bytes_rows.astype(int).tolist()


def test_index_life_cycle(spark, points, tmp_path):
    data, base = points
    queries = as_queries(base).where("qid < 5")
    index = VectorIndex(spark, "l2", 8).init_index(60, M=8, ef_construction=60)
    with pytest.raises(RuntimeError):
        index.init_index(10)
    index.add_items(base.where("id < 50"))
    index.set_ef(60)
    assert ids_of(index.knn_query(queries, 1)) == {i: [i] for i in range(5)}
    index.add_items(base.where("id between 50 and 59"))
    assert index.get_current_count() == 60 and index.get_ids_list().count() == 60
    with pytest.raises(ValueError, match="limit"):
        index.add_items(base.where("id = 100"))
    index.mark_deleted(2)
    assert ids_of(index.knn_query(queries.where("qid = 2"), 1)) != {2: [2]}
    with pytest.raises(KeyError):
        index.get_items(spark.createDataFrame([(2,)], "id long"))
    index.save_index(str(tmp_path / "index"))
    back = VectorIndex.load_index(spark, str(tmp_path / "index"), max_elements=100)
    assert (back.ef, back.max_elements, back.get_current_count()) == (60, 100, 60)
    back.unmark_deleted(2)
    assert ids_of(back.knn_query(queries, 1)) == {i: [i] for i in range(5)}
    with pytest.raises(ValueError):
        back.knn_query(queries, 3, where=F.col("label") == 1)
    with pytest.raises(ValueError):
        VectorIndex(spark, "hamming", 8)
    lazy = LazyIndex(spark, "l2", 8)
    assert lazy.knn_query(queries, 1).count() == 0
    lazy.add_items(data[:20])
    assert lazy.get_current_count() == 20
    exact = FlatIndex(spark, "cosine", 8)
    exact.add_items(base.where("id < 30"))
    exact.add_items(base.where("id between 20 and 40"))
    exact.delete_vector(1)
    assert exact.rows.count() == 40 and ids_of(exact.knn_query(queries.where("qid = 3"), 1)) == {3: [3]}


def test_streaming_upserts(spark, points, tmp_path):
    from lodestar.streaming.ingest import ingest

    data, base = points
    folder = str(tmp_path / "in")
    base.where("id < 30").write.parquet(folder)
    index = FlatIndex(spark, "l2", 8)
    ingest(spark.readStream.schema(base.schema).parquet(folder), index, str(tmp_path / "check")).awaitTermination()
    assert index.rows.count() == 30


def test_collectors_against_all_rows():
    """Searches that may visit every node find what sorting all of them finds."""
    rng = np.random.default_rng(12)
    data = rng.random((300, 6))
    g = Graph(6, "l2", M=8, ef_construction=60)
    for i, v in enumerate(data):
        g.add(v, i)
    docs = {i: i // 4 for i in range(300)}
    for q in rng.random((10, 6)):
        exact = sorted((float(((q - v) ** 2).sum()), i) for i, v in enumerate(data))
        label = lambda rows: [i for _, i in rows]
        assert label(g.search(q, 10, 300)) == label(exact[:10])
        assert label(g.search_until(q, Within(0.3, 300, 300))) == [i for d, i in exact if d <= 0.3]
        assert label(g.search_until(q, Within(0.3, 300, 5))) == [i for d, i in exact if d <= 0.3][:5]
        seen, want = set(), []
        for _, i in exact:
            seen.add(docs[i])
            if len(seen) > 3:
                break
            want.append(i)
        assert label(g.search_until(q, Documents(3, docs, 75))) == want


def test_moved_rows_are_found_and_links_stay_whole():
    rng = np.random.default_rng(13)
    data = rng.random((400, 8))
    g = Graph(8, "l2", M=8, ef_construction=60)
    for i, v in enumerate(data):
        g.add(v, i)
    for i in [g.labels[g.entry], *range(0, 400, 3)]:
        data[i] = rng.random(8)
        g.add(data[i], i)
    g.mend()
    assert g.check() == [] and len(g) == 400
    assert np.mean([g.search(v, 1, 60)[0][1] == i for i, v in enumerate(data)]) > 0.99


def test_broken_graph_is_reported(spark):
    """Each kind of damage on any level shows in the table's check."""
    from lodestar.operators import graph

    rng = np.random.default_rng(14)
    g = Graph(4, "l2", M=2, ef_construction=20)
    for i, v in enumerate(rng.random((120, 4))):
        g.add(v, i)
    g.mend()
    whole = spark.createDataFrame(graph._frame("0", g))
    assert graph.broken_links(whole).count() == 0
    high = next(s for s in range(120) if g.levels[s] > 0 and g.links[s][1])
    g.links[high][1] = [high, *g.links[high][1][:1], *g.links[high][1][:1]]
    lost = next(s for s in range(120) if s != high)
    for levels in g.links:
        levels[0] = [s for s in levels[0] if s != lost]
    found = {(r["node"], r["problem"]) for r in graph.broken_links(spark.createDataFrame(graph._frame("0", g))).collect()}
    assert found == {(high, "links to itself on level 1"), (high, "repeated link on level 1"), (lost, "no way in")}


def test_resize_deals_out_more_parts(spark, monkeypatch):
    from lodestar import api

    monkeypatch.setattr(api, "PART_ROWS", 50)
    rng = np.random.default_rng(15)
    data = rng.random((90, 4)).astype(np.float32)
    index = api.VectorIndex(spark, "l2", 4).init_index(50)
    index.add_items(data[:50])
    index.mark_deleted(3)
    index.resize_index(100)
    index.add_items(data[50:], ids=np.arange(50, 90))
    assert index.get_current_count() == 90 and index.graphs.select("part").distinct().count() == 2
    ids = spark.createDataFrame([(1,), (60,)], "id long")
    assert np.allclose(index.get_items(ids, "numpy"), data[[1, 60]]) and len(index.get_items(ids, "list")) == 2
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in (1, 60)], "qid long, qvec array<float>")
    assert {(r["qid"], r["id"]) for r in index.knn_query(queries, 1).collect()} == {(1, 1), (60, 60)}
