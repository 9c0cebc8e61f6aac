from __future__ import annotations

import corpus_pipeline
from graphloom.llm import decontaminate, simhash, suffix_dedup, toxicity
from graphloom.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    """Each stage's rows against a plain filter of its own input."""
    docs = table(spark, DIR, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
            return
        out = corpus_pipeline.cut(out)
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            scores = toxicity.tag(docs, table(spark, DIR, "labels")).select("doc_id", "tox_score").collect()
            assert ids == {r.doc_id for r in scores if r.tox_score < toxicity.THRESHOLD}
        elif name == "simhash_near_dedup":
            assert ids == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        elif name == "suffix_array_dedup":
            want = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.digests(docs).collect()}
            assert all(len(r.text.encode()) <= want[r.doc_id] for r in out.collect()) and len(want) == len(ids)
        else:
            bad = {r.doc_id for r in decontaminate.leaks(docs, table(spark, DIR, "benchmark")).collect()}
            assert ids == {r.doc_id for r in docs.collect()} - bad
        docs = out


def test_rows_without_an_id_and_with_a_shared_one(spark):
    """A leak takes its own row only, and each group of near duplicates keeps one row, whatever the ids are."""
    words = [f"w{k}" for k in range(400)]
    a, b, c, d = (" ".join(words[k : k + 60]) for k in (0, 100, 200, 300))
    rows = [(None, a), (None, b), (None, a), (5, a), (7, c), (7, d), (None, d), (7, c), (None, None)]
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, DIR)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, a), (None, b), (7, c), (7, d), (None, None)], key=str)
    bench = spark.createDataFrame([(1, a), (2, c)], "item_id long, text string")
    clean = sorted(((r.doc_id, r.text) for r in decontaminate.clean(docs, bench).collect()), key=str)
    assert clean == sorted([(None, b), (7, d), (None, d), (None, None)], key=str)
