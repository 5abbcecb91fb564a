"""Both jobs: growing input, reruns, replays, edge cases, command line, and their SQL."""

import json
import math
import os
import pathlib
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import corpus_drift, score_new_files
from jobs.common import config
from orrery.functions.text import LETTERS
from orrery.operators import vectors
from orrery.plans import jobs as J

HERE = pathlib.Path(score_new_files.__file__).parent.parent
SCHEMA = "vec_id long, embedding array<float>, label int, file_id string, month string"


def vectors_of(n, first=0, seed=0):
    rng = np.random.default_rng(seed)
    return [(first + i, [float(np.float32(x)) for x in rng.standard_normal(4) + 3 * (i % 3)], i % 3 + 5, "clash", "clash") for i in range(n)]


def state(spark, out):
    tokens = spark.read.schema(score_new_files.ASSIGNED).parquet(f"{out}/assignments").select("batch", "month", "file_id", "cell_id", "label", F.round("residual", 9))
    cube = spark.read.schema(score_new_files.CUBE).parquet(f"{out}/cube").select("month", "cell_id", "label", "n", F.round("residual", 6))
    return sorted(map(tuple, tokens.collect())), sorted(map(tuple, cube.collect()))


def nearest(rows, model, cells):
    """file, cell, cluster and residual by hand."""
    out = []
    for i, v, *_ in rows:
        gaps = {c: sum((x - y) ** 2 for x, y in zip(v, m, strict=True)) for c, m in model.items()}
        best = min(gaps, key=lambda c: (gaps[c], c))
        out.append((i // cells, i % cells, best, round(gaps[best], 6)))
    return sorted(out)


def test_new_files_are_taken_once(spark, tmp_path):
    settings = {"cells_per_file": 10, "files_per_batch": 1}
    tokens, out = f"{tmp_path}/tokens", f"{tmp_path}/out"
    early, late = vectors_of(60), vectors_of(1500, 60, 1)
    spark.createDataFrame(early, SCHEMA).coalesce(1).write.parquet(tokens)
    before = dict(spark.conf.getAll)
    score_new_files.run(spark, tokens, out, settings)
    first = state(spark, out)
    score_new_files.run(spark, tokens, out, settings)
    assert state(spark, out) == first and len(first[0]) == 60 and {r[0] for r in first[0]} == {0}
    frozen = {r["cluster"]: r["mean"] for r in spark.read.parquet(f"{out}/model/clusters").collect()}
    assert set(frozen) == {5, 6, 7}

    bad = [(None, [1.0] * 4, 5, "", ""), (-1, [1.0] * 4, 5, "", ""), (5000, None, 5, "", ""), (5001, [1.0], 5, "", ""), (5002, [float("nan")] * 4, 5, "", ""), (5003, [None, 1.0, 1.0, 1.0], 5, "", "")]
    spark.createDataFrame([*late, *bad], SCHEMA).repartition(2).write.mode("append").parquet(tokens)
    score_new_files.run(spark, tokens, out, settings)
    grown = state(spark, out)
    assert [r for r in grown[0] if r[0] == 0] == first[0] and {r[0] for r in grown[0]} == {0, 1, 2}
    assert {r["cluster"]: r["mean"] for r in spark.read.parquet(f"{out}/model/clusters").collect()} == frozen
    got = sorted((f, c, label, round(r, 6)) for _, _, f, c, label, r in grown[0])
    want = nearest([*early, *late], frozen, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(math.isclose(a[3], b[3], abs_tol=2e-6) for a, b in zip(got, want, strict=True))
    counts = {}
    for _, month, _, cell, label, _ in grown[0]:
        counts[month, cell, label] = counts.get((month, cell, label), 0) + 1
    assert {(m, c, label): n for m, c, label, n, _ in grown[1]} == counts
    found = score_new_files.run(spark, tokens, out, settings)
    assert state(spark, out) == grown
    best = {}
    for (month, cell, label), n in sorted(counts.items()):
        if n > best.get((month, cell), (0, 0))[0]:
            best[month, cell] = n, label
    assert {(r["month"], r["cell_id"]): (r["n"], r["label"]) for r in found["dominant"].collect()} == best
    for r in found["flips"].collect():
        pairs = [(x[1], best[r["month"] + 1, cell][1]) for (m, cell), x in best.items() if m == r["month"] and (m + 1, cell) in best]
        assert (r["both"], r["flips"]) == (len(pairs), sum(a != b for a, b in pairs)) and (r["rate"] is None) == (not pairs)
    assert dict(spark.conf.getAll) == before


def test_a_batch_taken_up_again_changes_nothing(spark, tmp_path):
    settings = config(score_new_files.NAME) | {"cells_per_file": 10}
    tokens, out = f"{tmp_path}/tokens", f"{tmp_path}/out"
    spark.createDataFrame(vectors_of(200), SCHEMA).write.parquet(tokens)
    score_new_files.run(spark, tokens, out, settings)
    once = state(spark, out)
    model = score_new_files.frozen_model(spark, tokens, out, settings)
    score_new_files.take_batch(spark.read.parquet(tokens), 0, model, [5, 6, 7], out, settings)
    assert state(spark, out) == once


def test_no_tokens_and_no_labels(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no labelled tokens"):
        score_new_files.run(spark, f"{tmp_path}/none", f"{tmp_path}/out")
    spark.createDataFrame(vectors_of(5), SCHEMA).write.mode("append").parquet(f"{tmp_path}/none")
    found = score_new_files.run(spark, f"{tmp_path}/none", f"{tmp_path}/out")  # as if nothing had happened
    assert found["assignments"].count() == 5 == found["cube"].agg(F.sum("n")).first()[0] and found["flips"].count() == 11


DOCS = [(0, "aab", "x"), (1, "aaab", "x"), (2, "bbb", "y"), (3, "bb zz" * 1000, "y"), (7, None, "x"), (8, "", None), (9, "AA\n12", None), (None, "bbb", "y"), (9, "aab", "y"), (9, "aab", "y")]


def by_hand(docs, buckets=10, most=64):
    count = lambda t: [t.count(c) for c in LETTERS]
    share = [[x / max(sum(c), 1) for x in c] for c in (count(t or "") for _, t, _ in docs)]
    n = {}
    for _, _, c in docs:
        n[c] = n.get(c, 0) + 1
    names = sorted(sorted((c for c in n if c is not None), key=lambda c: (-n[c], c))[:most])
    means = [[sum(col) / len(col) for col in zip(*[v for v, (_, _, c) in zip(share, docs, strict=True) if c == name], strict=True)] for name in names]
    ids = [i for i, _, _ in docs if i is not None]
    out = []
    for v, (i, _, c) in zip(share, docs, strict=True):
        gaps = [round(sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), 9) for m in means]
        best = min(range(len(gaps)), key=lambda k: (gaps[k], k)) if gaps else None
        out.append((i, c, best, gaps[best] if gaps else None, None if i is None else (i - min(ids)) * buckets // (max(ids) - min(ids) + 1)))
    return out


def test_drift_against_hand_computation(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").withColumns({c: F.lit("old") for c in ("cluster", "bucket", "counts", "class", "n")}).write.parquet(f"{tmp_path}/docs")
    before = dict(spark.conf.getAll)
    rows, drift = corpus_drift.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out")
    got = sorted(map(tuple, rows.collect()), key=str)
    want = sorted(by_hand(DOCS), key=str)
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want] and all(math.isclose(g[3], w[3], abs_tol=2e-9) for g, w in zip(got, want, strict=True))
    report = drift.collect()
    assert {r["class"] for r in report} == {"x", "y"} and sum(r["n"] for r in report) == 9
    n, of, total = {(r["bucket"], r["label"]): r["n"] for r in report}, {}, 9
    for (_, label), x in n.items():
        of[label] = of.get(label, 0) + x
    for r in report:
        inside = sum(x for (b, _), x in n.items() if b == r["bucket"])
        assert math.isclose(r["enrichment"], (r["n"] / of[r["label"]]) / (inside / total))
    again = corpus_drift.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out")
    assert sorted(map(tuple, again[0].collect()), key=str) == got and sorted(map(tuple, again[1].collect())) == sorted(map(tuple, report))
    assert dict(spark.conf.getAll) == before


def test_drift_of_empty_tables_and_without_classes(spark, tmp_path):
    schema = "doc_id long, text string, lang string"
    for name, docs in (("none", []), ("plain", [(1, "a", None), (2, "b", None)])):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}")
        rows, drift = corpus_drift.run(spark, f"{tmp_path}/{name}", f"{tmp_path}/{name}-out")
        assert rows.count() == len(docs) and drift.count() == 0 and all(r["cluster"] is None for r in rows.collect())


def test_assign_in_row_prefers_the_least_cluster(spark):
    model = spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [9.0, 9.0])], "cluster int, mean array<double>")
    rows = spark.createDataFrame([("tie", [0.0, 0.0]), ("two", [2.0, 0.0])], "name string, features array<double>")
    assert {r["name"]: (r["cluster"], r["residual"]) for r in vectors.assign_in_row(rows, model).collect()} == {"tie": (1, 1.0), "two": (2, 1.0)}


def test_command_lines(tmp_path):
    env = os.environ | {"PYTHONPATH": str(HERE), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    (tmp_path / "few.json").write_text(json.dumps({"buckets": 2}))
    run = lambda *args: subprocess.run([sys.executable, "-m", *args], env=env, cwd=tmp_path, capture_output=True, text=True, check=True)
    said = run("jobs.score_new_files", "--tokens", "/root/testdata/sf0.001/embeddings.parquet", "--out", f"{tmp_path}/a")
    assert "batch 0: read 500 rows" in said.stderr and (tmp_path / "a/cube/month=1").is_dir()
    said = run("jobs.corpus_drift", "--documents", "/root/testdata/sf0.001/documents.parquet", "--out", f"{tmp_path}/b", "--config", f"{tmp_path}/few.json")
    assert "rows of drift" in said.stderr and sorted(p.name for p in (tmp_path / "b/drift").glob("bucket=*")) == ["bucket=0", "bucket=1"]


@pytest.mark.parametrize("name", sorted(J.QUERIES))
def test_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    cursor = con.execute(J.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=str)
    df = J.QUERIES[name](spark, d)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    same = lambda x, y: math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y
    assert len(got) == len(want) > 0 and all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))
