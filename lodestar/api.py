"""Indexes with the life cycle of a library: make, add, query, delete, save, load.

An index is a table of graph nodes, one graph for each part of the labels. A change computes the
touched parts only, but writes a whole new version to the shared folder, so lineage stays short and a
lost executor costs a re-read; changes are best made many at a time.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.distance import distance
from lodestar.operators.flat import flat_topk, require_k
from lodestar.operators.graph import PART_ROWS, SCHEMA, _frame, graph_of, search_graphs
from lodestar.operators.hnsw import Collector, Graph
from lodestar.sources.shared import shared_folder

SPACES = ("l2", "ip", "cosine")


@dataclass
class Params:
    space: str
    dim: int
    max_elements: int = 0
    M: int = 16
    ef_construction: int = 200
    random_seed: int = 100
    allow_replace_deleted: bool = False
    ef: int = 10
    parts: int = 1


def _checked(data: DataFrame, dim: int) -> DataFrame:
    if data.where(F.col("vec").isNull() | (F.size("vec") != dim)).limit(1).count():
        raise ValueError(f"vectors must have {dim} dimensions")
    return data


class VectorIndex:
    """Graph index over ``(id, vec)``; spaces l2, ip and cosine."""

    def __init__(self, spark: SparkSession, space: str, dim: int):
        if space not in SPACES:
            raise ValueError(f"space must be one of {', '.join(SPACES)}")
        self.spark, self.params, self.graphs = spark, Params(space, dim), None
        self.folder, self.version = shared_folder(spark, "index"), 0

    # properties
    space = property(lambda self: self.params.space)
    dim = property(lambda self: self.params.dim)
    M = property(lambda self: self.params.M)
    ef_construction = property(lambda self: self.params.ef_construction)
    max_elements = property(lambda self: self.params.max_elements)
    element_count = property(lambda self: self.get_current_count())
    ef = property(lambda self: self.params.ef, lambda self, value: self.set_ef(value))

    def init_index(self, max_elements: int, M: int = 16, ef_construction: int = 200, random_seed: int = 100, allow_replace_deleted: bool = False) -> VectorIndex:
        if self.graphs is not None:
            raise RuntimeError("the index is already initiated")
        parts = max(1, -(-max_elements // PART_ROWS))
        self.params = Params(self.space, self.dim, max_elements, M, ef_construction, random_seed, allow_replace_deleted, 10, parts)
        self._write(self.spark.createDataFrame([], SCHEMA))
        return self

    def _ready(self) -> DataFrame:
        if self.graphs is None:
            raise RuntimeError("the index is not initiated")
        return self.graphs

    def _write(self, graphs: DataFrame) -> None:
        self.version += 1
        path = f"{self.folder}/v{self.version}"
        graphs.write.parquet(path)
        self.graphs = self.spark.read.schema(SCHEMA).parquet(path)

    def _part(self, label: Column) -> Column:
        return F.pmod(F.xxhash64(label.cast("long")), F.lit(self.params.parts)).cast("string")

    def _options(self) -> dict:
        p = self.params
        return {"M": p.M, "ef_construction": p.ef_construction, "seed": p.random_seed, "allow_replace_deleted": p.allow_replace_deleted}

    # changes
    def add_items(self, data: DataFrame | np.ndarray, ids=None, replace_deleted: bool = False) -> None:
        """Inserts rows (id, vec); a known label gets the new vector, and a deleted one is back.
        An array takes the given ids, or counts up from the number of elements."""
        graphs, p = self._ready(), self.params
        if replace_deleted and not p.allow_replace_deleted:
            raise ValueError("the index was made without allow_replace_deleted")
        if not isinstance(data, DataFrame):
            from lodestar.sources.vecfiles import from_numpy

            data = from_numpy(self.spark, data, ids, self.get_current_count())
        new = _checked(data.select("id", "vec"), p.dim).withColumn("part", self._part(F.col("id")))
        if p.max_elements and not replace_deleted:
            fresh = new.select("id").distinct().join(graphs.select(F.col("label").alias("id")), "id", "left_anti").count()
            if self.get_current_count() + fresh > p.max_elements:
                raise ValueError(f"the number of elements exceeds the limit of {p.max_elements}")
        options = self._options()

        def update(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return old
            g = graph_of(old, p.dim, p.space, **options) if len(old) else Graph(p.dim, p.space, M=p.M, ef_construction=p.ef_construction, seed=p.random_seed, allow_replace_deleted=p.allow_replace_deleted)
            for label, vec in rows.sort_values("id")[["id", "vec"]].itertuples(index=False):
                g.add(np.asarray(vec), int(label), replace_deleted)
            return _frame(rows["part"].iloc[0], g)

        self._write(graphs.groupBy("part").cogroup(new.groupBy("part")).applyInPandas(update, SCHEMA))

    def _flag(self, label: int, deleted: bool) -> None:
        rows = self._ready().where(F.col("label") == label).select("deleted").collect()
        if not rows:
            raise KeyError(f"label {label} not found")
        if rows[0]["deleted"] == deleted:
            raise ValueError(f"label {label} is {'already' if deleted else 'not'} deleted")
        self._write(self.graphs.withColumn("deleted", F.when(F.col("label") == label, F.lit(deleted)).otherwise(F.col("deleted"))))

    def mark_deleted(self, label: int) -> None:
        self._flag(label, True)

    def unmark_deleted(self, label: int) -> None:
        self._flag(label, False)

    def resize_index(self, max_elements: int) -> None:
        if max_elements < self.get_current_count():
            raise ValueError("the new limit is below the number of elements")
        self.params.max_elements = max_elements
        parts = max(1, -(-max_elements // PART_ROWS))
        if parts > self.params.parts:
            self._deal(parts)

    def _deal(self, parts: int) -> None:
        """Builds the graphs anew in more parts, so that no part outgrows a task."""
        self.params.parts = parts
        p, options = self.params, self._options()
        rows = self.graphs.select(F.col("label").alias("id"), "vec", "deleted").withColumn("part", self._part(F.col("id")))

        def build(own: pd.DataFrame) -> pd.DataFrame:
            g = Graph(p.dim, p.space, **options)
            for label, vec in own.sort_values("id")[["id", "vec"]].itertuples(index=False):
                g.add(np.asarray(vec), int(label))
            for label in own.loc[own["deleted"], "id"]:
                g.mark_deleted(int(label))
            return _frame(own["part"].iloc[0], g)

        self._write(rows.groupBy("part").applyInPandas(build, SCHEMA))

    def set_ef(self, ef: int) -> None:
        self.params.ef = ef

    # reading
    def get_current_count(self) -> int:
        """Deleted elements count too."""
        return self._ready().count()

    def get_max_elements(self) -> int:
        return self.params.max_elements

    def get_ids_list(self) -> DataFrame:
        return self._ready().select(F.col("label").alias("id"))

    def get_items(self, ids: DataFrame, return_type: str = "table") -> DataFrame | np.ndarray | list:
        """(id, vec) of the rows of ``ids(id)``; a missing or deleted one raises. ``return_type`` 'numpy' and 'list'
        bring the vectors to the driver, in the order of id."""
        if return_type not in ("table", "numpy", "list"):
            raise ValueError("return_type must be table, numpy or list")
        live = self._ready().where(~F.col("deleted")).select(F.col("label").alias("id"), "vec")
        if missing := ids.join(live, "id", "left_anti").limit(1).collect():
            raise KeyError(f"label {missing[0]['id']} not found")
        found = ids.select("id").join(live, "id")
        if return_type == "table":
            return found
        vectors = [r["vec"] for r in found.orderBy("id").collect()]
        return vectors if return_type == "list" else np.array(vectors, dtype=np.float32).reshape(-1, self.dim)

    def knn_query(self, queries: DataFrame, k: int = 1, where: Column | None = None, strict: bool = True) -> DataFrame:
        """(qid, id, dist, rank); raises under ``strict`` if a query finds fewer than k. ``where`` is over ``label``."""
        found = search_graphs(self._ready(), queries, k, self.dim, self.space, max(self.params.ef, k), where=where)
        return require_k(found, queries, k) if strict else found

    def search_until(self, queries: DataFrame, rule: Collector, k: int) -> DataFrame:
        return search_graphs(self._ready(), queries, k, self.dim, self.space, rule=lambda _: rule)

    # keeping
    def index_file_size(self) -> int:
        """Bytes of all vectors and links at 8 bytes a number."""
        total = self._ready().agg(F.sum(F.size("vec") + F.size("links"))).first()[0]
        return 8 * (total or 0)

    def save_index(self, path: str) -> None:
        self._ready().write.mode("overwrite").parquet(f"{path}/graphs")
        self.spark.createDataFrame([(json.dumps(asdict(self.params)),)], "params string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load_index(cls, spark: SparkSession, path: str, max_elements: int = 0, allow_replace_deleted: bool | None = None) -> VectorIndex:
        params = Params(**json.loads(spark.read.text(f"{path}/params").first()[0]))
        index = cls(spark, params.space, params.dim)
        index.params, index.graphs = params, spark.read.schema(SCHEMA).parquet(f"{path}/graphs")
        n = index.graphs.count()
        if max_elements:
            params.max_elements = max(max_elements, n)
        if allow_replace_deleted is not None:
            params.allow_replace_deleted = allow_replace_deleted
        if index.graphs.where("entry").groupBy("part").count().where("count != 1").limit(1).count():
            raise ValueError(f"{path} holds a part without one entry point")
        return index


class FlatIndex:
    """Exact index over ``(id, vec)``."""

    def __init__(self, spark: SparkSession, space: str, dim: int):
        distance(space)
        self.spark, self.space, self.dim, self.max_elements = spark, space, dim, 0
        self.rows = spark.createDataFrame([], "id long, vec array<float>")

    def init_index(self, max_elements: int) -> FlatIndex:
        self.max_elements = max_elements
        return self

    def add_items(self, data: DataFrame) -> None:
        new = _checked(data.select(F.col("id").cast("long"), F.col("vec").cast("array<float>")), self.dim)
        rows = self.rows.join(new.select("id"), "id", "left_anti").unionByName(new)
        if self.max_elements and rows.count() > self.max_elements:
            raise ValueError(f"the number of elements exceeds the limit of {self.max_elements}")
        path = shared_folder(self.spark, "flat")
        rows.write.parquet(path)
        self.rows = self.spark.read.schema(rows.schema).parquet(path)

    def delete_vector(self, label: int) -> None:
        self.rows = self.rows.where(F.col("id") != label)

    def knn_query(self, queries: DataFrame, k: int = 1, where: Column | None = None, strict: bool = False) -> DataFrame:
        found = flat_topk(self.rows, queries, k, self.space, where)
        return require_k(found, queries, k) if strict else found

    def save_index(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @classmethod
    def load_index(cls, spark: SparkSession, path: str, space: str, dim: int) -> FlatIndex:
        index = cls(spark, space, dim)
        index.rows = spark.read.parquet(path)
        return index


class LazyIndex(VectorIndex):
    """Is initiated by the first rows that come; a query before finds nothing."""

    def __init__(self, spark: SparkSession, space: str, dim: int, max_elements: int = 1024, **options):
        super().__init__(spark, space, dim)
        self._later = {"max_elements": max_elements, **options}

    def add_items(self, data, ids=None, replace_deleted: bool = False) -> None:
        if self.graphs is None:
            ef = self.params.ef
            self.init_index(**self._later)
            self.params.ef = ef
        super().add_items(data, ids, replace_deleted)

    def knn_query(self, queries: DataFrame, k: int = 1, where: Column | None = None, strict: bool = True) -> DataFrame:
        if self.graphs is None:
            return self.spark.createDataFrame([], "qid long, id long, dist double, rank long")
        return super().knn_query(queries, k, where, strict)
