import re
from collections import defaultdict

from pyspark.sql import functions as F

from orrery.llm.mixing import WEIGHTS, mix_sources, source_targets


def fill(sizes):
    """Reshares by weight until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: 3.0 * sizes[s] for s in above}
        left -= sum(3.0 * sizes[s] for s in above)
        open_ -= above
    return out


def test_targets(spark):
    for sizes in ({"a": 100, "b": 5, "c": 7, None: 3, "é": 1000}, {"a": 0}, {"x": 10}, {"a": 1, "b": 1, "c": 1000}, {"z": 0, "a": 50, "b": 40}):
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = fill(sizes)
        assert {r["source"]: round(r["target"], 6) for r in got} == {s: round(t, 6) for s, t in want.items()}


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")).alias("source"), F.lit(1).alias("size"))
    docs = docs.union(docs.limit(3)).union(docs.selectExpr("doc_id + 100000", "null", "source", "size").limit(5)).union(docs.selectExpr("null", "' \\n'", "source", "size").limit(2))
    docs = docs.cache()
    got = mix_sources(docs, carry=True, bucket_rows=8).select("document.text", "document.source", "doc_id", "size", "source_size", "target", "taken").collect()
    assert len(got) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = fill(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 and abs(target[s] - want[s]) < 1e-6 and all(r["source_size"] == sizes[s] for r in got if r["source"] == s) for s in want)
    for s in want:  # whole epochs first: documents differ by one epoch at most
        assert len({r["taken"] // r["size"] for r in got if r["source"] == s and r["size"]}) <= 2
    again = mix_sources(docs, bucket_rows=8).select("doc_id", "size", "taken").collect()
    assert sorted(again, key=str) == sorted([(r["doc_id"], r["size"], r["taken"]) for r in got], key=str)
    assert mix_sources(docs.limit(0)).count() == 0


def test_better_documents_come_first(spark):
    good, bad = "word " * 30, "w " * 30
    docs = spark.createDataFrame([(i, good if i % 2 else bad, s) for i in range(2000) for s in ("a", "b")], "doc_id long, text string, source string")
    r = mix_sources(docs).where("source_size > target").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("t")).collect()
    t = {x["good"]: x["t"] for x in r}
    assert t[1] > 1.2 * t[0]


def test_documents_are_not_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mix_sources(docs, carry=True, bucket_rows=8)._jdf.queryExecution().executedPlan().toString()
    # only what lies in the bucket where a source's budget runs out
    assert plan.count("Exchange hashpartitioning") == 1 and not re.search(r"hashpartitioning\([^)]*bucket", plan)
