"""Parts that no registered query shows: further file kinds, own distances, labels from outside, figures, sizes."""

from __future__ import annotations

import csv

import numpy as np
import pytest
from lodestar.api import FlatIndex, VectorIndex
from lodestar.functions import distance as distances
from lodestar.functions.distance import register_distance
from lodestar.operators import evaluate, flat
from lodestar.sources.vecfiles import from_numpy, read_vectors, with_labels
from pyspark.sql import functions as F

DATA = np.random.default_rng(8).random((200, 6), dtype=np.float32)


@pytest.fixture(scope="module")
def rows(spark):
    return from_numpy(spark, DATA).cache()


@pytest.fixture(scope="module")
def few(rows):
    return rows.where("id < 10").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "ibin"])
def test_file_kinds(spark, tmp_path, kind):
    data = DATA.astype("<f4") if kind == "fvecs" else (DATA * 1000).astype("<i4") - 500
    path = tmp_path / f"a.{kind}"
    if kind == "ibin":
        path.write_bytes(np.array(data.shape, "<u4").tobytes() + data.tobytes())
    else:
        path.write_bytes(b"".join(np.int32(6).tobytes() + r.tobytes() for r in data))
    got = read_vectors(spark, str(path), rowsPerPartition=64)
    assert got.rdd.getNumPartitions() == 4
    assert np.array_equal(np.array([r["vec"] for r in got.orderBy("id").collect()], dtype=data.dtype), data)
    path.write_bytes(path.read_bytes()[:-2])
    with pytest.raises(Exception, match="shorter|one dimension"):
        read_vectors(spark, str(path)).collect()


def test_own_distance(rows, few, monkeypatch):
    monkeypatch.setattr(distances, "_known", dict(distances._known))
    register_distance(
        "l1",
        lambda q, b: F.aggregate(F.zip_with(q, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x),
        lambda q, b: np.abs(q[:, None] - b[None]).sum(2),
    )
    want = np.abs(DATA[:10, None].astype(np.float64) - DATA[None]).sum(2).argsort(1, kind="stable")[:, :5]
    for engine in ("arrow", "sql"):
        got = flat.flat_topk(rows, few, 5, "l1", engine=engine).orderBy("qid", "rank").collect()
        assert [r["id"] for r in got] == want.ravel().tolist()
    with pytest.raises(ValueError, match="unknown space"):
        flat.flat_topk(rows, few, 5, "l7")


def test_labels_from_outside(spark, rows, few):
    found = flat.flat_topk(rows, few, 2, "l2")
    got = with_labels(found, spark.createDataFrame([(i, f"name {i}", 0) for i in range(5)], "id long, ext_label string, rank int")).collect()
    assert len(got) == 20
    assert all(r["ext_label"] == (f"name {r['id']}" if r["id"] < 5 else None) for r in got)


def test_least_ef():
    recalls, asked = {10: 0.5, 20: 0.9, 40: 0.99}, []

    def recall_of(ef):
        asked.append(ef)
        return recalls[ef]

    assert evaluate.least_ef(recalls, recall_of, 0.9) == (20, 0.9) and asked == [10, 20]
    assert evaluate.least_ef(recalls, recall_of, 0.999) is None


def test_metrics_as_csv(spark, tmp_path):
    for value in ("0.5", "0.75"):  # written over
        evaluate.write_metrics(spark.createDataFrame([("ef", value)], "name string, value string"), str(tmp_path / "m"))
    (part,) = (tmp_path / "m").glob("part-*.csv")
    assert list(csv.reader(part.open())) == [["name", "value"], ["ef", "0.75"]]


def test_sizes_and_items(spark, rows, few, tmp_path):
    index = VectorIndex(spark, "l2", 6).init_index(300, M=4, ef_construction=30)
    assert index.index_file_size() == 0
    index.add_items(rows)
    numbers = index.graphs.select(F.size("vec").alias("d"), F.size("links").alias("m")).collect()
    assert index.index_file_size() == 8 * sum(r["d"] + r["m"] for r in numbers) > 8 * 200 * 6
    ids = spark.createDataFrame([(3,), (1,)], "id long")
    assert np.allclose(index.get_items(ids, "numpy"), DATA[[1, 3]]) and np.allclose(index.get_items(ids, "list"), DATA[[1, 3]])
    with pytest.raises(ValueError, match="return_type"):
        index.get_items(ids, "tuple")
    exact = FlatIndex(spark, "l2", 6).init_index(300)
    exact.add_items(rows)
    exact.save_index(str(tmp_path / "flat"))
    again = FlatIndex.load_index(spark, str(tmp_path / "flat"), "l2", 6)
    assert sorted(map(tuple, again.knn_query(few, 3).collect())) == sorted(map(tuple, exact.knn_query(few, 3).collect()))
