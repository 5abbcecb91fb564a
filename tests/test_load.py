"""The load call: what it reads, checks and writes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from orrery.sources import load, store
from orrery.sources.schema import LoadConfig

FILES, CELLS, DIM = 40, 12, 4


def table(spark, path, **kw):
    rows = spark.range(FILES * CELLS).select((F.col("id") / CELLS).cast("int").alias("file_id"), (F.col("id") % CELLS).cast("int").alias("cell_id"), F.array(*[(F.col("id") + i).cast("double") for i in range(DIM)]).alias("features"))
    load.write_token_table(rows, path, **kw)
    return rows


def scanned(df):
    """Files and rows that the scan of the token table has read."""
    df = df.select("*")  # a plan that hasn't run yet: the number of files is counted once
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan
    found = []

    def walk(node):
        if "Scan parquet" in node.nodeName():
            metrics = node.metrics()
            found.append(tuple(metrics.get(m).get().value() for m in ("numFiles", "numOutputRows")))
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(plan)
    return found


def picked(n, seed):
    return sorted(range(FILES), key=lambda f: (hashlib.md5(f"{f}|{seed}".encode()).hexdigest(), f))[:n]


def test_only_the_files_of_the_sample_are_read(spark, tmp_path):
    table(spark, f"{tmp_path}/t")
    got = load.load_tokens(spark, f"{tmp_path}/t", LoadConfig(num_files=5, seed=3, dim=DIM, n_cells=CELLS), f"{tmp_path}/run")
    assert got.files == picked(5, 3) and got.fingerprint == hashlib.sha1(f"|3|{','.join(map(str, sorted(got.files)))}".encode()).hexdigest()[:12]
    rows = got.tokens.collect()
    assert sorted((r["file_id"], r["cell_id"]) for r in rows) == sorted((f, c) for f in got.files for c in range(CELLS))
    assert all(r["rank"] == got.files.index(r["file_id"]) and r["fingerprint"] == got.fingerprint and r["features"][0] == r["file_id"] * CELLS + r["cell_id"] for r in rows)
    ((files, read),) = scanned(got.tokens)
    assert files == 5 and read == 5 * CELLS  # of 40 files
    assert store.manifest(spark, f"{tmp_path}/run/sample.json").first().asDict() == {"fingerprint": got.fingerprint, "num_files": 5, "tokens_per_file": None, "seed": 3, "src": f"{tmp_path}/t", "files": got.files}


def test_folders_of_several_files(spark, tmp_path):
    table(spark, f"{tmp_path}/t", files_per_folder=8)
    cfg = LoadConfig(num_files=2, seed=1, dim=DIM, tokens_per_file=5, files_per_folder=8, n_files_total=FILES)
    got = load.load_tokens(spark, f"{tmp_path}/t", cfg)
    want = sorted((f, c) for f in picked(2, 1) for c in sorted(range(CELLS), key=lambda c: (hashlib.md5(f"{f}|{c}|1".encode()).hexdigest(), c))[:5])
    assert sorted((r["file_id"], r["cell_id"]) for r in got.tokens.collect()) == want
    assert sum(read for _, read in scanned(got.tokens)) <= 2 * 8 * CELLS


def test_a_manifest_gives_the_same_tokens_again(spark, tmp_path):
    table(spark, f"{tmp_path}/t")
    cfg = LoadConfig(num_files=4, seed=9, dim=DIM, tokens_per_file=3, n_cells=CELLS)
    first = load.load_tokens(spark, f"{tmp_path}/t", cfg, f"{tmp_path}/a")
    again = load.load_tokens(spark, f"{tmp_path}/t", LoadConfig(num_files=1, seed=9, dim=DIM, tokens_per_file=3, n_cells=CELLS, files_from=f"{tmp_path}/a/sample.json"), f"{tmp_path}/b")
    assert again.files == first.files and again.fingerprint == first.fingerprint
    assert sorted(map(tuple, again.tokens.collect())) == sorted(map(tuple, first.tokens.collect())) and first.tokens.count() == 12
    assert load.load_tokens(spark, f"{tmp_path}/t", LoadConfig(num_files=0, dim=DIM)).tokens.count() == 0


def test_wrong_shapes_fail(spark, tmp_path):
    rows = table(spark, f"{tmp_path}/t")
    path = f"{tmp_path}/t"
    go = lambda p=path, **kw: load.load_tokens(spark, p, LoadConfig(**({"num_files": FILES, "dim": DIM, "n_cells": CELLS} | kw)))
    with pytest.raises(Exception, match="without 5 features"):
        go(dim=5).tokens.collect()
    with pytest.raises(ValueError, match="12 tokens of 12 cells, not 13"):
        go(n_cells=13)
    with pytest.raises(ValueError, match=r"file \d+ has 0 tokens"):
        go(n_files_total=FILES + 1, num_files=FILES + 1)
    with pytest.raises(MemoryError):
        go(tokens_per_file=10, max_bytes=100)
    for name, bad in (("twice", rows.union(rows.where("file_id = 3 and cell_id = 4"))), ("short", rows.where("not (file_id = 3 and cell_id = 4)"))):
        load.write_token_table(bad, f"{tmp_path}/{name}")
        with pytest.raises(ValueError, match="file 3 has"):
            go(f"{tmp_path}/{name}")
    odd = rows.withColumn("cell_id", F.when((F.col("file_id") == 3) & (F.col("cell_id") == 4), -1).otherwise(F.col("cell_id")))
    load.write_token_table(odd, f"{tmp_path}/odd")
    with pytest.raises(Exception, match="cell -1"):
        go(f"{tmp_path}/odd").tokens.collect()
    hole = rows.withColumn("features", F.when((F.col("file_id") == 3) & (F.col("cell_id") == 4), F.array(F.lit(None).cast("double"), *[F.lit(1.0)] * 3)).otherwise(F.col("features")))
    load.write_token_table(hole, f"{tmp_path}/hole")
    with pytest.raises(Exception, match="without 4 features"):
        go(f"{tmp_path}/hole").tokens.collect()
