"""Every registered query of the engine against its SQL, on whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from lodestar.plans.oracles import ORACLES
from lodestar.plans.queries import LEAST_RECALL, QUERIES, RECALLED

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = db.execute(ORACLES[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == columns
    want = sorted((tuple(r[have.index(c)] for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("name", RECALLED)
def test_recall(spark, name):
    """Searches that aren't exact, at their ordinary settings, against exact search."""
    sf = "/root/testdata/sf0.1"
    truth = {(r["qid"], r["id"]) for r in QUERIES["flat_ip_topk"](spark, sf).collect()}
    got = {(r["qid"], r["id"]) for r in QUERIES[name](spark, sf).collect()}
    assert len(got & truth) / len(truth) >= LEAST_RECALL


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
