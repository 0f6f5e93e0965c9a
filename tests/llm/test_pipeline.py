"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from mediaspark.llm import minhash, secrets

from . import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(before)
            return
        assert out.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        gone = set(before) - set(rows)
        if name == "toxicity":
            assert gone and not any(labels.get(k) == 0 for k in gone)
        elif name == "near_dedup":
            component = brute.near_duplicates(before)
            assert set(rows) == {k for k, c in component.items() if k == c}
        elif name == "decontamination":
            assert gone == {k for k, v in brute.contamination(before, items).items() if v[4]}
        else:
            assert not gone
            for k, text in rows.items():
                assert (text == before[k]) == (not brute.secrets(before[k])[4])
        docs = out


def test_rows_without_id_or_text_stay(spark):
    docs = spark.createDataFrame([(None, "same text here five words", "x"), (None, "same text here five words", "x"), (3, None, "y")], "doc_id bigint, text string, _row string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.count() == 3 and out.columns == docs.columns
    assert corpus_pipeline.drop_contaminated(spark, docs, SF).count() == 3
    assert sorted(map(tuple, secrets.mask(docs).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(3))
    rows = [(3, b), (5, b), (5, a), (7, c), (7, c + " end"), (7, c), (9, a + " end"), (2, None), (2, "!")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, _k1 int")
    classes = {(r["doc_id"], r["class_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert {x for x in classes if x[0] in (3, 5, 9, 2)} == {(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (2, 2, True)}
    assert {x for x in classes if x[0] == 7} == {(7, 7, True), (7, 7, False)}
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs.drop("_k1"), SF).collect()]
    assert {x for x in kept if x[0] != 7} == {(3, b), (5, a), (2, None), (2, "!")}
    assert len([x for x in kept if x[0] == 7]) == 1
    triple = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id bigint, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, triple, SF).collect())) == sorted([(3, a), (5, b)])


def test_empty_tables_and_odd_rows_pass_all_stages(spark):
    long = "plain words that go on " * 20_000
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "...", None), (4, long, "x"), (4, long, "x"), (None, "some text", "x")], "doc_id bigint, text string, severity string")
    for docs, n in ((odd.limit(0), 0), (odd, 5)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "severity"], name
        assert docs.count() == n
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (n > 0)
