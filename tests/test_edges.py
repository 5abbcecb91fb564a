import hashlib
import json

import pytest
from pyspark.sql import functions as F

from orrery.operators import compare, sampling, spatial, temporal
from orrery.operators.report import cluster_report, temporal_report
from orrery.operators.subspaces import assigned, fit, model_from
from orrery.sources import schema, store
from orrery.sources.schema import FitConfig
from orrery.streaming.scoring import read_token_stream, score_stream


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id int, cell_id int, label int")


def test_ties_empty_clusters_and_buckets(spark):
    # Cells 1 (tie of 0 and 2) and 5; cluster 1 is empty; files 0 and 1300 of 13021: deciles 0 and 0.
    a = frame(spark, [(0, 1, 2), (0, 1, 0), (1, 5, 2), (2000, 5, 2)])
    assert {r["cell_id"]: (r["label"], r["n"]) for r in spatial.dominant(spatial.cell_cluster_counts(a)).collect()} == {1: (0, 1), 5: (2, 2)}
    assert {r["label"]: r["owned"] for r in spatial.owned_cells(a, 3).collect()} == {0: 1, 1: 0, 2: 1}
    assert {r["label"]: r["cells50"] for r in spatial.cells_at_half(a, 3, 192).collect()} == {0: 1, 1: 193, 2: 1}
    grid = spatial.enrichment(spatial.bucket_counts(a, F.floor(F.col("file_id") * 10 / 13021).cast("int"), "decile"), "decile", 3)
    assert {r["decile"] for r in grid.collect()} == {0, 1} and grid.count() == 6
    one = spatial.variation(spatial.enrichment(spatial.bucket_counts(frame(spark, [(f, 1, 0) for f in range(10)] + [(3, 2, 1)]), F.col("file_id"), "b"), "b", 2)).collect()
    assert {r["label"]: round(r["cv"], 6) for r in one}[1] == 3.0  # one of ten buckets, population deviation


def test_months_without_common_cells(spark):
    # January has cell 1, February cell 2: no cell to compare; no other month has data.
    months = temporal.cube(frame(spark, [(0, 1, 0), (4 * 40, 2, 1)]))
    rates = {r["month"]: r["rate"] for r in temporal.flip_rates(months).collect()}
    assert len(rates) == 11 and set(rates.values()) == {None}
    assert temporal.shift(months).first()["rate"] is None
    files = {r["month"]: r["files"] for r in temporal.files_per_month(spark.range(13021).select(F.col("id").cast("int").alias("file_id"))).collect()}
    assert [files[m] for m in range(1, 13)] == [1116, 1016, 1116, 1080, 1116, 1080, 1116, 1116, 1080, 1116, 1077, 992]


def test_samples(spark):
    files = spark.range(500).select(F.col("id").cast("int").alias("file_id"))
    got = sampling.sample_files(files, 20, 3).orderBy("rank").collect()
    want = sorted(range(500), key=lambda f: (hashlib.md5(f"{f}|3".encode()).hexdigest(), f))[:20]
    assert [r["file_id"] for r in got] == want
    text = f"100|3|{','.join(map(str, sorted(want)))}"
    chosen = sampling.sample_files(files, 20, 3)
    assert sampling.fingerprint(chosen, 100, 3).first()[0] == hashlib.sha1(text.encode()).hexdigest()[:12]
    assert sampling.fingerprint(chosen, 100, None).first()[0] == hashlib.sha1(f"100|{text.split('|')[2]}".encode()).hexdigest()[:12]
    pool = sampling.holdout_pool(files, chosen, 30, 1)
    assert pool.count() == 30 and pool.join(chosen, "file_id").count() == 0


def test_agreement(spark):
    a = spark.createDataFrame([(i % 3, i % 3, 0, (i // 3) % 3) for i in range(90)], "a int, b int, c int, d int")
    assert compare.nmi(a, "a", "b").first()[0] == pytest.approx(1) and compare.ari(a, "a", "b").first()[0] == pytest.approx(1)
    assert compare.nmi(a, "a", "d").first()[0] == pytest.approx(0, abs=1e-9) and compare.nmi(a, "c", "c").first()[0] == 1 and compare.ari(a, "c", "c").first()[0] == 1


@pytest.fixture(scope="module")
def run(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((120, 6)) + 6, rng.standard_normal((120, 6)) * [3, 1, 1, 1, 1, 1]])
    tokens = spark.createDataFrame([(i // 48 * 900, i % 48, v.astype("float32").tolist()) for i, v in enumerate(x)], schema.TOKENS)
    return tokens, fit(tokens, FitConfig(clusters=2, dim=1, iters=4, min_count=4))


def test_store(spark, run, tmp_path):
    tokens, model = run
    info = spark.createDataFrame([("abc", FitConfig(clusters=2, dim=1).as_map(), [0, 900], model.final_obj_per_token)], schema.RUN)
    history = spark.createDataFrame(model.history).select([f.name for f in schema.HISTORY])
    rows = model.rows(spark)
    store.save_model(rows, info, history, f"{tmp_path}/m")
    back, info2, _ = store.load_model(spark, f"{tmp_path}/m")
    assert (model_from(back).bases == model.bases).all() and info2.first()["config"]["method"] == "subspace_kmeans"
    with pytest.raises(ValueError):
        store.save_model(rows.withColumn("eigvals", F.array(F.lit(1.0), F.lit(2.0))), info, history, f"{tmp_path}/bad")
    labels = assigned(tokens, model).select("file_id", "cell_id", "label")
    store.save_assignments(labels, f"{tmp_path}/a")
    saved = store.load_assignments(spark, f"{tmp_path}/a")
    assert saved.count() == 240 and compare.count_mismatches(rows, saved).isEmpty()
    assert store.backfill_manifest(spark, info, f"{tmp_path}/sample.json", 48, 0, "src") and not store.backfill_manifest(spark, info, f"{tmp_path}/sample.json", 48, 0, "src")
    assert store.manifest(spark, f"{tmp_path}/sample.json").first()["files"] == [0, 900]
    store.write_json(spark, {"a": {"b": 1}}, f"{tmp_path}/h.json")
    assert store.read_json(spark, f"{tmp_path}/h.json") == {"a": {"b": 1}}
    tokens.write.parquet(f"{tmp_path}/t")
    assert store.read_tokens(spark, f"{tmp_path}/t", 6).count() == 240
    with pytest.raises(Exception, match="doesn't have 7"):
        store.read_tokens(spark, f"{tmp_path}/t", 7).collect()
    half = store.half_precision(tokens).first()["features"]
    import numpy as np

    assert half == [float(np.float16(v)) for v in tokens.first()["features"]]


def test_coastlines(spark, tmp_path):
    shape = {"features": [{"geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}}, {"geometry": {"type": "MultiLineString", "coordinates": [[[4, 5], [6, 7]], [[8, 9]]]}}, {"geometry": {"type": "Point", "coordinates": [1, 1]}}]}
    (tmp_path / "c.json").write_text(json.dumps(shape))
    assert sorted(r["points"] for r in store.coastlines(spark, str(tmp_path / "c.json")).collect()) == [[[0, 1], [2, 3]], [[4, 5], [6, 7]], [[8, 9]]]


def test_reports(spark, run):
    tokens, model = run
    labels = assigned(tokens, model).select("file_id", "cell_id", "label").persist()
    text = cluster_report(spark, model, labels, 48, 13021, FitConfig(clusters=2, dim=1).as_map())
    assert "## Variance" in text and "subspace_kmeans" in text and "| 0 |" in text
    assert "–" in temporal_report(labels, 2)


def test_stream(spark, run, tmp_path):
    tokens, model = run
    tokens.write.parquet(f"{tmp_path}/in")
    score_stream(read_token_stream(spark, f"{tmp_path}/in"), model, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 240 and got.join(assigned(tokens, model).select("file_id", "cell_id", F.col("label").alias("x")), ["file_id", "cell_id"]).where("label <> x").isEmpty()
