"""The dedup stage leaves texts where they are."""

from __future__ import annotations

import corpus_pipeline


def test_texts_are_not_shuffled_for_the_verdicts(spark):
    long = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(3, long), (1, long), (2, "other words than those"), (None, long), (4, None)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.dedup(spark, docs, "")
        assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 4]
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
