"""Graphs of the parts of a table, and the searches composed of them.

``base(id, vec, part)`` becomes one graph for each part, built and searched where the part lies. Parts
are bounded: ``split_parts`` cuts larger ones, so no group of rows grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.hnsw import Collector, Documents, Graph, Nearest
from lodestar.operators.kmeans import partition_centroids
from lodestar.operators.scan import query_blocks, ranked
from lodestar.sources.shared import shared_folder

#: Rows of one graph.
PART_ROWS = 20_000
SCHEMA = "part string, node long, label long, level int, deleted boolean, entry boolean, vec array<double>, links array<long>"


def split_parts(parted: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """``parted(id, vec, part)`` with part as text, and parts of more than ``rows`` rows cut by a hash of id."""
    # a hash deals unevenly, so cuts are meant to be smaller by a twentieth
    cuts = F.when(F.count("*") <= rows, 1).otherwise(F.ceil(F.count("*") * 1.05 / rows)).cast("int")
    sizes = parted.groupBy("part").agg(cuts.alias("cuts"))
    cut = F.pmod(F.xxhash64("id"), F.col("cuts"))
    name = F.when(F.col("cuts") <= 1, F.col("part").cast("string")).otherwise(F.concat_ws(".", F.col("part").cast("string"), cut.cast("string")))
    return parted.join(sizes, "part").select("id", "vec", F.col("part").alias("group"), name.alias("part"))


def build_graphs(parted: DataFrame, dim: int, metric: str = "ip", M: int = 16, ef_construction: int = 150, seed: int = 100) -> DataFrame:
    """The nodes of every part's graph; rows are inserted in order of id, labels are ids."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        g = Graph(dim, metric, M, ef_construction, seed)
        for label, vec in rows.sort_values("id")[["id", "vec"]].itertuples(index=False):
            g.add(np.asarray(vec), int(label))
        g.mend()
        return _frame(rows["part"].iloc[0], g, arrays=True)

    return _dealt(parted.select("id", "vec", F.col("part").cast("string").alias("part"))).groupBy("part").applyInPandas(build, SCHEMA)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by part, over enough tasks that few parts share one: parts cost far more than their bytes say."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, "part")


def _frame(part: str, g: Graph, arrays: bool = False) -> pd.DataFrame:
    """The nodes as lists of numbers, or as arrays, which take a fraction of the memory."""
    rows = [(*own, g.vectors[own[0]], np.array(links, dtype=np.int64)) for *own, _, links in g.rows()] if arrays else list(g.rows())
    out = pd.DataFrame(rows, columns=["node", "label", "level", "deleted", "entry", "vec", "links"])
    out.insert(0, "part", part)
    return out


def graph_of(rows: pd.DataFrame, dim: int, metric: str, **options) -> Graph:
    return Graph.of_rows(rows[["node", "label", "level", "deleted", "entry", "vec", "links"]].itertuples(index=False, name=None), dim, metric=metric, **options)


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int, dim: int, metric: str = "ip", ef: int = 100, parts: DataFrame | None = None, where: Column | None = None, rule: Callable[[pd.DataFrame], Collector] | None = None, each: int | None = None, written: bool = False) -> DataFrame:
    """(qid, id, dist, rank): every part's graph is searched for ``each`` (k if none) rows, and the best k are kept.

    ``parts(qid, part)`` says which parts a query searches, all if none. ``where`` is a predicate on
    the nodes' columns; nodes that don't fit are passed through. ``rule`` makes another collector from a
    part's nodes, which may have further columns. ``written`` says that reading ``graphs`` again doesn't build them again.
    """
    flagged = graphs.withColumn("allowed", F.lit(True) if where is None else F.coalesce(where, F.lit(False)))

    def searcher(qids: np.ndarray, q: np.ndarray, chosen: dict[str, list[int]] | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            part = rows["part"].iloc[0]
            mine = range(len(q)) if chosen is None else sorted(chosen.get(part, []))
            out: list[tuple] = []
            if mine:
                g = graph_of(rows, dim, metric)
                allowed = None if rows["allowed"].all() else set(rows.loc[rows["allowed"], "label"].tolist())
                most = (each or k) if rule is None else None
                collector = Nearest(max(ef, most)) if rule is None else rule(rows)
                for i, hits in zip(mine, g.search_many(q[list(mine)], collector, allowed, most), strict=True):
                    out += [(int(qids[i]), int(label), float(d)) for d, label in hits]
            return pd.DataFrame(out, columns=["qid", "id", "dist"])

        return run

    found = None
    blocks = query_blocks(queries)
    head = list(islice(blocks, 2))
    if len(head) > 1 and not written:  # else each block's search would build the graphs anew
        path = shared_folder(graphs.sparkSession, "graphs")
        flagged.write.parquet(path)
        flagged = graphs.sparkSession.read.parquet(path)
    for qids, q in chain(head, blocks):
        chosen = None
        if parts is not None:  # block x parts at most
            chosen = {}
            place = {int(x): i for i, x in enumerate(qids)}
            for r in parts.where(F.col("qid").between(int(qids[0]), int(qids[-1]))).select("qid", "part").distinct().collect():
                if r["qid"] in place:
                    chosen.setdefault(str(r["part"]), []).append(place[r["qid"]])

        rows = flagged if chosen is None else flagged.where(F.col("part").isin(sorted(chosen)))
        one = _dealt(rows).groupBy("part").applyInPandas(searcher(qids, q, chosen), "qid long, id long, dist double")
        found = one if found is None else found.union(one)
    return ranked(found.dropDuplicates(["qid", "id"]), k)


def search_cost(graphs: DataFrame, queries: DataFrame, k: int, dim: int, metric: str = "ip", ef: int = 100) -> DataFrame:
    """(qid, part, hops, distances): nodes expanded and distances computed by each query in each part."""

    def counter(qids: np.ndarray, q: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            g, out = graph_of(rows, dim, metric), []
            for i in range(len(q)):
                g.hops = g.distances = 0
                g.search(q[i], k, ef)
                out.append((int(qids[i]), rows["part"].iloc[0], g.hops, g.distances))
            return pd.DataFrame(out, columns=["qid", "part", "hops", "distances"])

        return run

    blocks = [graphs.groupBy("part").applyInPandas(counter(qids, q), "qid long, part string, hops long, distances long") for qids, q in query_blocks(queries)]
    return reduce(DataFrame.union, blocks)


def documents_rule(num_docs: int, ef: int = 10) -> Callable[[pd.DataFrame], Collector]:
    """The collector of a search by documents over nodes that have a column ``doc_id``, for ``whole_documents`` to cut.

    A part gives one document more than is asked for: where the first one too many begins has to be known from the
    part that holds it, as other parts may have vectors of the documents asked for that come after.
    """
    return lambda rows: Documents(num_docs + 1, dict(zip(rows["label"], rows["doc_id"], strict=True)), ef)


def whole_documents(result: DataFrame, docs: DataFrame, num_docs: int) -> DataFrame:
    """Cuts merged results of parts: the vectors before the first one of a query's (num_docs + 1)-th document."""
    rows = result.join(docs.select("id", "doc_id"), "id")
    first = rows.groupBy("qid", "doc_id").agg(F.min("rank").alias("first"))
    past = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).where(F.col("place") == num_docs + 1)
    bounded = rows.join(past.select("qid", F.col("first").alias("bound")), "qid", "left")
    return bounded.where(F.col("bound").isNull() | (F.col("rank") < F.col("bound"))).drop("bound")


def broken_links(graphs: DataFrame) -> DataFrame:
    """(part, node, problem) of every node with a wrong link on any level, or without a link to it on level 0, in column functions alone."""
    one = F.struct(F.lit(1).alias("at"), F.array().cast("array<array<bigint>>").alias("lists"))

    def step(acc: Column, _: Column) -> Column:
        n = F.element_at("links", acc["at"]).cast("int")
        return F.struct((acc["at"] + n + 1).alias("at"), F.concat(acc["lists"], F.array(F.slice("links", acc["at"] + 1, n))).alias("lists"))

    by_level = F.aggregate(F.sequence(F.lit(0), F.col("level")), one, step, lambda acc: acc["lists"])
    lists = graphs.select("part", "node", F.posexplode(by_level).alias("lv", "near"))
    named = lambda text: F.when(F.col("lv") == 0, text).otherwise(F.concat(F.lit(f"{text} on level "), F.col("lv").cast("string"))).alias("problem")
    own = lists.where(F.array_contains("near", F.col("node"))).select("part", "node", named("links to itself"))
    twice = lists.where(F.size(F.array_distinct("near")) < F.size("near")).select("part", "node", named("repeated link"))
    reached = lists.where("lv = 0").select("part", F.explode("near").alias("node")).distinct()
    several = graphs.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    lost = graphs.select("part", "node").join(reached, ["part", "node"], "left_anti").join(several, "part", "left_semi")
    return own.unionByName(twice).unionByName(lost.select("part", "node", F.lit("no way in").alias("problem")))


def select_parts(parted: DataFrame, queries: DataFrame, parts: int, nprobe: int, dim: int, metric: str = "ip", M: int = 16, ef: int = 50) -> DataFrame:
    """(qid, part): for each query the parts whose means a graph over all means finds nearest."""
    rows = partition_centroids(parted, parts).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    means = {r["part"]: np.array([x["value"] for x in r["v"]]) for r in rows.collect()}  # one row for each part
    top = Graph(dim, metric, M, 150)
    for p in sorted(means):
        top.add(means[p], int(p))
    found = [(int(qid), int(p)) for qids, q in query_blocks(queries) for qid, v in zip(qids, q, strict=True) for _, p in top.search(v, nprobe, max(ef, nprobe))]
    return parted.sparkSession.createDataFrame(found, "qid long, part long")


def searched_parts(chosen: DataFrame, split: DataFrame) -> DataFrame:
    """(qid, part): chosen parts in terms of the parts they were cut into."""
    names = split.select(F.col("group").cast("long").alias("group"), "part").distinct()
    return chosen.select("qid", F.col("part").cast("long").alias("group")).join(names, "group").select("qid", "part")
