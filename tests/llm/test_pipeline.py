"""The pipeline's stages on their own inputs, against brute force."""

import re

import corpus_pipeline
from tests.llm.test_op1 import brute as windows
from tests.llm.test_op4 import brute as groups
from tests.llm.test_op5 import brute as personal
from tests.llm.test_op8 import fill

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = dict(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic").collect())
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        after = {r["doc_id"]: r for r in out.collect()}
        texts = [(d, r["text"]) for d, r in before.items()]
        if name != "mixing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "toxicity":
            wrong = sum((d in after) == bool(t) for d, t in labels.items())
            assert wrong <= 0.05 * len(labels)
        elif name == "ngram_jaccard_join":
            assert set(after) == {d for d, _, c in groups(texts) if d == c}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in windows(texts, items) if not r[-1]}
        elif name == "personal_data":
            assert set(after) == set(before)
            assert not any(personal(r["text"]) for r in after.values()) and all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert all(r == before[d] for d, r in after.items() if not re.search("[0-9@]", before[d]["text"]))
        else:
            sizes, taken = {}, {}
            for d, r in before.items():
                n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
                assert after[d]["size"] == n
                sizes[r["source"]] = sizes.get(r["source"], 0) + n
                taken[r["source"]] = taken.get(r["source"], 0) + after[d]["taken"]
            assert all(abs(taken[s] - t) <= 1 for s, t in fill(sizes).items())
        docs, before = out, after


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.count() < spark.read.parquet(f"{SMALL}/documents.parquet").count() and "taken" in out.columns


def test_stages_accept_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "You idiot " * 5, "en", None, 50)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        assert stage(spark, odd, SMALL).count() >= 1


CLASHING = ("size", "Taken", "taken_given", "document", "score", "predicted", "kept", "contaminated", "node", "n", "head_id", "head_key", "rows", "text_key", "spans", "target_given")


def test_stages_keep_columns_of_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING}).cache()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SMALL).cache()
        assert out.count() > 0
        for r in out.collect():
            for c in CLASHING:
                given = {"size": "size_given", "Taken": "Taken_given_given"}.get(c, c) if name == "mixing" else c
                assert r[given] == f"{c} of {r['doc_id']}"
        if name == "mixing":
            assert out.columns[-4:] == list(corpus_pipeline.MIXED) and all(isinstance(r["size"], int) and isinstance(r["taken"], int) for r in out.collect())
        else:
            assert out.columns == wide.columns
        wide = out


def test_stages_take_very_long_texts(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    long = " ".join(f"word{i % 9973}x{i % 7919}" for i in range(200_000))
    docs = spark.createDataFrame([(10, long, "en", "a", len(long)), (11, long + " tail", "en", "a", len(long) + 5), (12, "short text of a few plain words", "en", "b", 31), (13, long[::-1], "en", "b", len(long))], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        assert sorted(r["doc_id"] for r in out.collect()) == ([10, 12, 13] if name != "toxicity" else [10, 11, 12, 13])
        assert next(len(r["text"]) for r in out.collect() if r["doc_id"] == 10) == len(long)
        docs = out
