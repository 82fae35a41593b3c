from __future__ import annotations

import corpus_pipeline
from lodestar.llm import secrets
from lodestar.llm.queries import QUERIES, tokenizer_path

from tests.llm import brute


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, sf)
        got = {r["doc_id"]: r for r in df.collect()}
        assert got and got.keys() <= before.keys()
        if name != "bpe":
            assert df.columns == columns
        if name == "quality_rules":
            verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op8_quality_rules"](spark, sf).collect()}
            assert got.keys() == {i for i, kept in verdict.items() if kept}
        if name == "near_dedup":
            assert got.keys() == {i for i, x in brute.near([(i, r["text"]) for i, r in before.items()]).items() if x[2]}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            ids = sorted(before)
            hit = [x[4] for x in brute.contamination([before[i]["text"] for i in ids], items)]
            assert got.keys() == {i for i, h in zip(ids, hit, strict=True) if not h}
        if name == "secret_scans":
            assert got.keys() == before.keys()
            for i, r in got.items():
                assert sum(brute.secrets(r["text"])[:3]) == 0
                if not sum(brute.secrets(before[i]["text"])[:3]):
                    assert "entropy" in str(secrets.KINDS) and (r["text"] == before[i]["text"] or "[SECRET]" in r["text"])
        if name == "bpe":
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer_path())
            assert got.keys() == before.keys()
            for i, r in got.items():
                assert r["token_ids"] == t.encode(before[i]["text"], add_special_tokens=False).ids
        out[name], before = got, got
        if name != "bpe":
            docs = spark.createDataFrame(list(got.values()), docs.schema)
    assert {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, sf).collect()} == {i: r["token_ids"] for i, r in out["bpe"].items()}


def test_dedup_takes_five_words(spark, sf):
    words = [f"w{i}" for i in range(42)]
    near, copy = [*words[:20], "other", *words[21:]], [*words[:1], *words[1:]]
    rows = [(0, " ".join(words)), (1, " ".join(near)), (2, " ".join(copy)), (3, "alone")]
    assert [x[2] for x in brute.near(rows, 4).values()] == [True, False, False, True]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).collect()}
    assert got == {i for i, x in brute.near(rows, 5).items() if x[2]} == {0, 1, 3}


def test_stages_on_edge_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows, clashing names and an empty table, for every stage."""
    good = " ".join(f"word{i} and{i * 7 % 31} then{i}" for i in range(40))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 200").first()["text"]
    key = "password = " + "Zq7RtYP9XyQ9Lm2P"
    texts = [
        (1, good), (2, good), (2, good), (3, None), (4, ""), (None, good + " " + key), (None, good), (None, item), (5, item), (6, "x " * 50_000), (7, key), (7, "other " + key),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, secret_spans string, spans string, kept_id long, hit_key string, n long, `a.b` int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", "own", 5, "h", 6, 7) for i, t in texts], schema)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf)
        got, none = found.collect(), stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and none.schema == found.schema
        if name == "bpe":
            assert len(got) == len(texts) and all(r["n_tokens"] == len(r["token_ids"]) for r in got)
            continue
        assert found.columns == docs.columns
        assert all((r["secret_spans"], r["spans"], r["kept_id"], r["hit_key"], r["n"], r["a.b"]) == ("mine", "own", 5, "h", 6, 7) for r in got)
        kept = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
        if name == "near_dedup":
            want = [(1, good), (3, None), (4, ""), (None, good + " " + key), (None, good), (None, item), (5, item), (6, "x " * 50_000), (7, key), (7, "other " + key)]
            assert kept == sorted(want, key=str)
        if name == "decontamination":
            assert kept == sorted(((i, t) for i, t in texts if t != item), key=str)
        if name == "secret_scans":
            assert kept == sorted(((i, t and t.replace(key, "[SECRET]")) for i, t in texts), key=str)
            assert all(r["n_chars"] == len(r["text"] or "") for r in got)
        if name == "quality_rules":
            assert not {3, 4, 6, 7} & {i for i, _ in kept} and sum(t == good for _, t in kept) in (0, 4)
