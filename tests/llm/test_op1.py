import hashlib
import re

from pyspark.sql import functions as F

from orrery.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, s in items:
            v = words(s)
            k = min(window, len(v))
            wins = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1) if v else []:
                if tuple(w[p : p + k]) in wins:
                    hit |= set(range(p, p + k))
                    ids |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n_hit string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(d, b, **more)
    got = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("s"), "contaminated")
    return sorted((tuple(r) for r in got.collect()), key=str)


LONG = " ".join(f"w{i % 37}x{i % 11}" for i in range(3000))
ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (10, "Á b-c"), (2, "single"), (3, None), (4, "..."), (None, "no id here"), (2, "single"), (5, " ".join(LONG.split()[500:540]))]
DOCS = [(1, "x one TWO, three four five six seven eight nine ten eleven twelve y"), (2, None), (3, ""), (4, "Á b c single Single á B C"), (5, LONG), (5, LONG), (None, "no id here"), (6, "two three four five six seven eight nine ten eleven")]


def test_against_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_blocks_change_nothing(spark):
    assert run(spark, DOCS, ITEMS, block_bytes=200) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS, []) == brute(DOCS, [])


def test_sample_of_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs, items = [tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.select("item_id", "text").collect()]
    assert run(spark, docs, items) == brute(docs, items)
