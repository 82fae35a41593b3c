"""The engine's queries over ``embeddings``: every row is searched, and every twentieth row is a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import evaluate, flat, graph, ivf, kmeans, partition
from lodestar.operators import product_quantization as pq
from lodestar.operators import scalar_quantization as sq
from lodestar.operators.hnsw import Within
from lodestar.sources.shared import shared_folder
from lodestar.sources.vecfiles import read_vectors, write_fbin

K, NLIST, ITERATIONS = 10, 16, 4
#: The vectors hardly cluster, so a recall of 0.9 needs most lists and a fifth of the rows as a shortlist of coarse codes.
NPROBE, SHORT_SHARE = 14, 5
SQ_NPROBE, PQ_M, PQ_KS = 20, 32, 64
#: Without a rerank the scores stand, so residuals are coded more finely.
RESIDUAL_SAMPLES, RESIDUAL_M, RESIDUAL_KS = 512, 64, 128
PARTS, DIM = 4, 64
ADAPTIVE = (2, 16, 0.06, 0.97)
SWEEP_NPROBE, SWEEP_TAU, SWEEP_COVERAGE = (1, 2, 4, 8), (0.015, 0.03, 0.06), (0.8, 0.9, 0.95)


def base_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def queries_of(base: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20, against all rows."""
    return base.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = base_of(spark, sf_dir)
    return base, queries_of(base)


def shortlist_rows(base: DataFrame, parts: int = 1) -> int:
    """A fixed share of the rows, dealt to the parts."""
    return max(K, base.count() // (SHORT_SHARE * parts))


class Made:
    """What several searches of one run need, made and written once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def once(self, name: str, make: Callable[[], DataFrame | ivf.InvertedLists]) -> DataFrame | ivf.InvertedLists:
        if name not in self.known:
            new = make()
            self.known[name] = ivf.InvertedLists(new.centroids, self.written(new.assigned)) if isinstance(new, ivf.InvertedLists) else self.written(new)
        return self.known[name]

    def written(self, rows: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "made")
        rows.write.parquet(path)
        return self.spark.read.parquet(path)


def _out(result: DataFrame) -> DataFrame:
    return result.select("qid", "id", "rank", F.round("dist", 4).alias("dist"))


def flat_by(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base, queries = _loaded(spark, sf_dir)
        return _out(flat.flat_topk(base, queries, K, metric))

    return run


def flat_sql_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    return _out(flat.flat_topk(base, queries, K, "ip", engine="sql"))


def flat_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    return _out(flat.flat_topk(base, queries, K, "l2", where=F.col("label") < 5))


def epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    return _out(flat.epsilon_search(base, queries, 1.2))


def multivector(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    rows = flat.document_search(base.withColumn("doc_id", F.floor(F.col("id") / 5)), queries, 5)
    return rows.select("qid", "doc_id", "id", "rank", F.round("dist", 4).alias("dist"))


def integer_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    byte = lambda v: F.transform(v, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("smallint"))
    return _out(flat.flat_topk(base.select("id", byte("vec").alias("vec")), queries.select("qid", byte("qvec").alias("qvec")), K, "l2_int"))


def closer_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    return _out(flat.closer_first(flat.flat_topk(base, queries, K, "ip")))


def sq_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(sq.train(base_of(spark, sf_dir)), 6),)], "scale double")


def sq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_of(spark, sf_dir)
    codes = sq.encode_table(base, sq.train(base))
    return codes.select("id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


def _sq(base: DataFrame, queries: DataFrame) -> DataFrame:
    scale = sq.train(base)
    return sq.sq_search(base, sq.encode_table(base, scale), scale, queries, K, SQ_NPROBE)


def sq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_sq(*_loaded(spark, sf_dir)))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    rows = evaluate.recall(_sq(base, queries), flat.flat_topk(base, queries, K, "ip"), queries, K)
    return rows.select("qid", "hits", F.round("recall", 4).alias("recall"))


def _ivf(base: DataFrame, made: Made | None = None) -> ivf.InvertedLists:
    build = lambda: ivf.build_lists(base, NLIST, ITERATIONS, metric="ip", empty="reseed", final_reassign=True)
    return build() if made is None else made.once("lists", build)


def kmeans_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = kmeans.kmeans(base_of(spark, sf_dir), NLIST, ITERATIONS, "l2", "reseed", True)
    return rows.select("id", "cid")


def kmeans_ip_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = kmeans.kmeans(base_of(spark, sf_dir), NLIST, ITERATIONS, "ip", "zero", False)
    return rows.select("id", "cid")


def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _ivf(base_of(spark, sf_dir))
    return index.centroid_table().select("cid", F.posexplode("cvec").alias("dim", "value")).select("cid", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def ivf_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf(base_of(spark, sf_dir)).assigned.groupBy("cid").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def ivf_list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.list_stats(_ivf(base_of(spark, sf_dir)).assigned).select("lists", "largest", "smallest", F.round("mean", 4).alias("mean"))


def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    return ivf.probe(queries, _ivf(base).centroids, NPROBE).select("qid", "cid", "rank", F.round("score", 6).alias("score"))


def _fixed(spark: SparkSession, sf_dir: str, made: Made | None = None):
    base, queries = _loaded(spark, sf_dir)
    index = _ivf(base, made)
    return base, queries, index, ivf.probe(queries, index.centroids, NPROBE)


def ivf_search_fixed(spark: SparkSession, sf_dir: str, made: Made | None = None) -> DataFrame:
    _, queries, index, probes = _fixed(spark, sf_dir, made)
    return _out(ivf.ivf_search(index, queries, probes, K))


def ivf_union_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, queries, index, probes = _fixed(spark, sf_dir)
    return _out(ivf.union_search(index, queries, probes, K))


def ivf_union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, probes = _fixed(spark, sf_dir)
    return ivf.union_rows(index, probes).select("id", "cid")


def ivf_valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, probes = _fixed(spark, sf_dir)
    return ivf.candidate_pairs(index, probes)


def ivf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, probes = _fixed(spark, sf_dir)
    return ivf.candidate_counts(index, probes)


def ivf_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, probes = _fixed(spark, sf_dir)
    return evaluate.batch_stats(probes, index.assigned, 200)


def ivf_l2_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    index = ivf.build_lists(base, NLIST, ITERATIONS, metric="l2", empty="reseed", final_reassign=True)
    return _out(ivf.ivf_search(index, queries, ivf.probe(queries, index.centroids, NPROBE), K))


def adaptive_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    return ivf.adaptive_probe(queries, _ivf(base).centroids, *ADAPTIVE).select("qid", "cid", "rank")


def adaptive_search(spark: SparkSession, sf_dir: str, made: Made | None = None) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    index = _ivf(base, made)
    return _out(ivf.ivf_search(index, queries, ivf.adaptive_probe(queries, index.centroids, *ADAPTIVE), K))


def adaptive_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and candidates of fixed and adaptive probing over the published grid."""
    base, queries = _loaded(spark, sf_dir)
    index = _ivf(base)
    truth = flat.flat_topk(base, queries, K, "ip")
    grid = [("fixed", n, 0.0, 0.0) for n in SWEEP_NPROBE] + [("adaptive", 0, t, c) for t in SWEEP_TAU for c in SWEEP_COVERAGE]

    def run(method: str, nprobe: int, tau: float, coverage: float) -> DataFrame:
        probes = ivf.probe(queries, index.centroids, nprobe) if method == "fixed" else ivf.adaptive_probe(queries, index.centroids, 2, 16, tau, coverage)
        config = (F.lit(method).alias("method"), F.lit(nprobe).cast("long").alias("nprobe"), F.lit(tau).alias("tau"), F.lit(coverage).alias("coverage"))
        counts = ivf.candidate_counts(index, probes).agg(F.avg("nprobe").alias("probes"), F.avg("candidates").alias("candidates"))
        hits = evaluate.mean_recall(ivf.ivf_search(index, queries, probes, K), truth, queries, K)
        return hits.join(counts, F.lit(True)).select(*config, F.round("recall", 6).alias("recall"), F.round("probes", 6).alias("probes"), F.round("candidates", 6).alias("candidates"))

    return evaluate.sweep(grid, run)


def pq_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pq.sample_codebook(base_of(spark, sf_dir), PQ_M, PQ_KS).table(spark)
    return words.select("m", "k", F.posexplode("word").alias("dim", "value")).select("m", "k", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_of(spark, sf_dir).select("id", "vec")
    codes = pq.encode_table(base, pq.sample_codebook(base, PQ_M, PQ_KS))
    return codes.select("id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


def pq_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    tables = pq.lookup_tables(queries, pq.sample_codebook(base, PQ_M, PQ_KS))
    return tables.select("qid", F.posexplode("lut").alias("at", "value")).select("qid", F.col("at").cast("long").alias("at"), F.round("value", 6).alias("value"))


def pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    book = pq.sample_codebook(base, PQ_M, PQ_KS)
    return _out(pq.pq_search(base, pq.encode_table(base.select("id", "vec"), book), book, queries, K, shortlist_rows(base)))


def ivfpq_search(spark: SparkSession, sf_dir: str, made: Made | None = None) -> DataFrame:
    base, queries, index, probes = _fixed(spark, sf_dir, made)
    book = pq.sample_codebook(base, PQ_M, PQ_KS)
    return _out(pq.ivfpq_search(index, pq.encode_table(index.assigned.select("id", "cid", "vec"), book), book, queries, probes, K, shortlist_rows(base)))


def _residual(spark: SparkSession, sf_dir: str, rerank: bool, made: Made | None = None) -> DataFrame:
    base, queries, index, probes = _fixed(spark, sf_dir, made)
    book = pq.train_residual_codebook(index, RESIDUAL_M, RESIDUAL_KS, RESIDUAL_SAMPLES, 3)
    coded = pq.encode_table(index.assigned.select("id", "cid", "vec"), book, index.centroids)
    return _out(pq.ivfpq_search(index, coded, book, queries, probes, K, shortlist_rows(base) if rerank else None))


def ivfpq_residual_search(spark: SparkSession, sf_dir: str, made: Made | None = None) -> DataFrame:
    return _residual(spark, sf_dir, False, made)


def ivfpq_rerank(spark: SparkSession, sf_dir: str, made: Made | None = None) -> DataFrame:
    return _residual(spark, sf_dir, True, made)


def parted(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return partition.with_part(base_of(spark, sf_dir), PARTS, mode).select("id", "part")

    return run


def partition_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kmeans.partition_centroids(partition.with_part(base_of(spark, sf_dir), PARTS), PARTS)
    return rows.select("part", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def part_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.part_stats(partition.with_part(base_of(spark, sf_dir), PARTS, "hash"))


def dist_ivf_topk(spark: SparkSession, sf_dir: str, made: Made | None = None) -> DataFrame:
    base, queries, index, probes = _fixed(spark, sf_dir, made)
    spread = partition.with_part(index.assigned, PARTS, "cyclic").repartition(PARTS, "part")
    return _out(ivf.ivf_search(ivf.InvertedLists(index.centroids, spread), queries, probes, K))


def dist_ivfpq_topk(spark: SparkSession, sf_dir: str, made: Made | None = None) -> DataFrame:
    base, queries, index, probes = _fixed(spark, sf_dir, made)
    book = pq.sample_codebook(base, PQ_M, PQ_KS)
    coded = pq.encode_table(partition.with_part(index.assigned, PARTS, "block").select("id", "cid", "vec", "part"), book)
    return _out(pq.ivfpq_search_by_part(index, coded, book, queries, probes, K, shortlist_rows(base, PARTS)))


def fbin_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written as one fbin file in the shared folder and read back by the data source."""
    base, folder = base_of(spark, sf_dir), shared_folder(spark, "fbin")
    write_fbin(base, f"{folder}/base.fbin")
    rows = read_vectors(spark, f"{folder}/base.fbin", rowsPerPartition=500)
    return rows.select("id", F.posexplode("vec").alias("dim", "value")).select("id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


def delete_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.api import FlatIndex

    base, queries = _loaded(spark, sf_dir)
    index = FlatIndex(spark, "l2", DIM)
    index.add_items(base)
    for label in (0, 20, 40):
        index.delete_vector(label)
    return _out(index.knn_query(queries, K))


def upsert_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of label 0 get the negated vector and are upserted; then the search."""
    from lodestar.api import FlatIndex

    base, queries = _loaded(spark, sf_dir)
    index = FlatIndex(spark, "ip", DIM)
    index.add_items(base)
    index.add_items(base.where("label = 0").withColumn("vec", F.transform("vec", lambda x: -x)))
    return _out(index.knn_query(queries, K))


def _one_part(base: DataFrame, spark: SparkSession) -> DataFrame:
    return graph.build_graphs(graph.split_parts(base.withColumn("part", F.lit(0))), DIM)


def hnsw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    return _out(graph.search_graphs(_one_part(base, spark), queries, K, DIM, ef=100))


def hnsw_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam as wide as the part finds what exact search finds."""
    base, queries = _loaded(spark, sf_dir)
    return _out(graph.search_graphs(_one_part(base, spark), queries, K, DIM, ef=graph.PART_ROWS))


def hnsw_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of other labels are passed through; a wide beam finds what exact search finds."""
    base, queries = _loaded(spark, sf_dir)
    split = graph.split_parts(base.withColumn("part", F.lit(0)))
    graphs = graph.build_graphs(split, DIM, "l2")
    fits = base.select(F.col("id").alias("label"), (F.col("label") < 5).alias("fits"))
    return _out(graph.search_graphs(graphs.join(fits, "label"), queries, K, DIM, "l2", graph.PART_ROWS, where=F.col("fits")))


def hnsw_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius search on graphs, going on until as many nodes as a part holds have been found."""
    base, queries = _loaded(spark, sf_dir)
    graphs = graph.build_graphs(graph.split_parts(partition.with_part(base, PARTS, "hash")), DIM, "l2")
    return _out(graph.search_graphs(graphs, queries, base.count(), DIM, "l2", rule=lambda _: Within(1.2, graph.PART_ROWS, graph.PART_ROWS)))


def hnsw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by documents on graphs, collecting all documents of a part before it stops."""
    base, queries = _loaded(spark, sf_dir)
    docs = base.select("id", F.floor(F.col("id") / 5).alias("doc_id"))
    graphs = graph.build_graphs(graph.split_parts(base.withColumn("part", F.lit(0))), DIM, "l2")
    graphs = graphs.join(docs.select(F.col("id").alias("label"), "doc_id"), "label")
    found = graph.search_graphs(graphs, queries, graph.PART_ROWS, DIM, "l2", rule=graph.documents_rule(5, graph.PART_ROWS))
    rows = graph.whole_documents(found, docs, 5)
    return rows.select("qid", "doc_id", "id", "rank", F.round("dist", 4).alias("dist"))


def hnsw_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    return graph.search_cost(_one_part(base, spark), queries, K, DIM)


def hnsw_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.broken_links(_one_part(base_of(spark, sf_dir), spark))


def partition_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    split = graph.split_parts(partition.with_part(base, PARTS, "hash"))
    return _out(graph.search_graphs(graph.build_graphs(split, DIM), queries, K, DIM, ef=100))


def _list_graphs(index: ivf.InvertedLists, made: Made | None) -> tuple[DataFrame, DataFrame]:
    """The rows by list, and a graph for each list."""
    split = graph.split_parts(index.assigned.withColumn("part", F.col("cid")))
    return split, graph.build_graphs(split, DIM) if made is None else made.once("list graphs", lambda: graph.build_graphs(split, DIM))


def ivf_hnsw(spark: SparkSession, sf_dir: str, made: Made | None = None) -> DataFrame:
    """A graph for each list; a query searches the graphs of the lists that it probes."""
    base, queries, index, probes = _fixed(spark, sf_dir, made)
    split, graphs = _list_graphs(index, made)
    chosen = graph.searched_parts(probes.select("qid", F.col("cid").alias("part")), split)
    return _out(graph.search_graphs(graphs, queries, K, DIM, ef=100, parts=chosen, written=made is not None))


def hnsw_on_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of row numbers have means that say little about their rows, so a recall of 0.9 needs them all."""
    base, queries = _loaded(spark, sf_dir)
    rows = partition.with_part(base, 2 * PARTS, "block")
    split = graph.split_parts(rows)
    chosen = graph.searched_parts(graph.select_parts(rows, queries, 2 * PARTS, 2 * PARTS, DIM), split)
    return _out(graph.search_graphs(graph.build_graphs(split, DIM), queries, K, DIM, ef=100, parts=chosen))


def ivf_hnsw_on_hnsw(spark: SparkSession, sf_dir: str, made: Made | None = None) -> DataFrame:
    base, queries = _loaded(spark, sf_dir)
    index = _ivf(base, made)
    split, graphs = _list_graphs(index, made)
    chosen = graph.searched_parts(graph.select_parts(index.assigned.withColumn("part", F.col("cid")), queries, NLIST, NPROBE, DIM), split)
    return _out(graph.search_graphs(graphs, queries, K, DIM, ef=100, parts=chosen, written=made is not None))


def search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether searches at an ordinary beam reach the floor of 0.9 against exact search, by name.

    Each search runs to its end by itself and leaves one row, as all of them in one plan would hold memory together.
    """
    base, queries = _loaded(spark, sf_dir)
    made = Made(spark)
    truth = made.written(flat.flat_topk(base, queries, K, "ip").select("qid", "id", "rank"))

    def reached(name: str) -> tuple[str, bool | None]:
        found = QUERIES[name](spark, sf_dir, made) if name in ON_LISTS else QUERIES[name](spark, sf_dir)
        recall = evaluate.mean_recall(found, truth, queries, K).first()["recall"]
        return name, None if recall is None else recall >= LEAST_RECALL

    return spark.createDataFrame([reached(name) for name in RECALLED], "name string, reached boolean")


LEAST_RECALL = 0.9
#: Searches that aren't exact.
RECALLED = (
    "sq_search", "ivf_search_fixed", "adaptive_search", "ivf_fullscan_l2build", "pq_search", "ivfpq_search", "ivfpq_residual_search", "ivfpq_rerank", "dist_ivf_topk",
    "dist_ivfpq_topk", "hnsw_knn", "partition_hnsw", "ivf_hnsw", "hnsw_on_hnsw", "ivf_hnsw_on_hnsw",
)
#: Of these, the ones on the same inverted lists.
ON_LISTS = {"ivf_search_fixed", "adaptive_search", "ivfpq_search", "ivfpq_residual_search", "ivfpq_rerank", "dist_ivf_topk", "dist_ivfpq_topk", "ivf_hnsw", "ivf_hnsw_on_hnsw"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flat_ip_topk": flat_by("ip"),
    "flat_l2_topk": flat_by("l2"),
    "flat_cosine_topk": flat_by("cosine"),
    "flat_sql_topk": flat_sql_engine,
    "flat_int_l2_topk": integer_l2,
    "flat_filtered_topk": flat_filtered,
    "epsilon_search": epsilon,
    "multivector_docs": multivector,
    "closer_first": closer_first,
    "recall_at_k": recall_at_k,
    "sq_train": sq_scale,
    "sq_encode": sq_encode,
    "sq_search": sq_search,
    "kmeans_l2": kmeans_l2,
    "kmeans_ip_stale": kmeans_ip_stale,
    "kmeans_centroids": kmeans_centroids,
    "ivf_lists": ivf_lists,
    "ivf_list_stats": ivf_list_stats,
    "ivf_probe": ivf_probe,
    "ivf_search_fixed": ivf_search_fixed,
    "ivf_union_search": ivf_union_search,
    "ivf_union_rows": ivf_union_rows,
    "ivf_valid_pairs": ivf_valid_pairs,
    "ivf_candidates": ivf_candidates,
    "ivf_batch_stats": ivf_batch_stats,
    "ivf_fullscan_l2build": ivf_l2_build,
    "adaptive_probe": adaptive_probe,
    "adaptive_search": adaptive_search,
    "adaptive_sweep": adaptive_sweep,
    "pq_codebook": pq_codebook,
    "pq_encode": pq_encode,
    "pq_lut": pq_lut,
    "pq_search": pq_search,
    "ivfpq_search": ivfpq_search,
    "ivfpq_residual_search": ivfpq_residual_search,
    "ivfpq_rerank": ivfpq_rerank,
    "partition_block": parted("block"),
    "partition_cyclic": parted("cyclic"),
    "partition_hash": parted("hash"),
    "partition_stats": part_stats,
    "partition_centroids": partition_centroids,
    "dist_ivf_topk": dist_ivf_topk,
    "dist_ivfpq_topk": dist_ivfpq_topk,
    "fbin_scan": fbin_scan,
    "delete_then_search": delete_then_search,
    "upsert_then_search": upsert_then_search,
    "hnsw_exhaustive_ef": hnsw_exhaustive,
    "hnsw_filtered": hnsw_filtered,
    "hnsw_epsilon": hnsw_epsilon,
    "hnsw_documents": hnsw_documents,
    "hnsw_cost": hnsw_cost,
    "hnsw_integrity": hnsw_integrity,
    "hnsw_knn": hnsw_knn,
    "partition_hnsw": partition_hnsw,
    "ivf_hnsw": ivf_hnsw,
    "hnsw_on_hnsw": hnsw_on_hnsw,
    "ivf_hnsw_on_hnsw": ivf_hnsw_on_hnsw,
    "search_recall": search_recall,
}
