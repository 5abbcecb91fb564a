"""Run folders end to end: fit, reports, hold-out evaluation, comparison of runs, and their command lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import cli
from orrery.operators import compare, holdout, programs, report
from orrery.sources import load, schema, store
from orrery.sources.schema import FitConfig, HoldoutConfig, LoadConfig

FILES, CELLS, WIDTH = 24, 48, 6


def features():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((FILES * CELLS, WIDTH)) * np.array([3, 2, 0.2, 0.2, 0.2, 0.2])
    x[::2] = rng.standard_normal((FILES * CELLS // 2, WIDTH))[:, ::-1] * np.array([0.2, 0.2, 0.2, 0.2, 2, 3]) + 7
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("runs"))
    rows = [(i // CELLS, i % CELLS, v.tolist()) for i, v in enumerate(features())]
    load.write_token_table(spark.createDataFrame(rows, schema.TOKENS), f"{path}/tokens")
    for name, seed in (("one", 1), ("two", 2)):
        args = f"fit --src {path}/tokens --out {path}/{name} --num-files 8 --clusters 3 --dim 2 --iters 4 --seed {seed} --min-count 4 --features {WIDTH} --cells {CELLS} --tokens-per-file {CELLS}"
        said = cli.run(spark, cli.parser().parse_args(args.split()))
        assert f"run folder {path}/{name}" in said
    return path


def test_a_run_folder_holds_the_fit(spark, place):
    rows, run, history = store.load_model(spark, f"{place}/one/model")
    row, sample = run.first(), store.manifest(spark, f"{place}/one/sample.json").first()
    assert row["files"] == sample["files"] and len(sample["files"]) == 8 and row["fingerprint"] == sample["fingerprint"] and sample["tokens_per_file"] == CELLS
    assert compare.count_mismatches(rows, store.load_assignments(spark, f"{place}/one/assignments")).isEmpty()
    assert row["config"]["clusters"] == "3" and row["config"]["src"] == f"{place}/tokens" and history.count() == 4
    again = cli.run(spark, cli.parser().parse_args(f"fit --src {place}/tokens --out {place}/again --files-from {place}/one/sample.json --clusters 3 --dim 2 --iters 4 --seed 1 --min-count 4 --features {WIDTH} --cells {CELLS} --tokens-per-file {CELLS}".split()))
    assert f"{row['final_obj_per_token']:.4f}" in again
    rows = {r["parameter"]: r["value"] for r in report.configuration(store.load_model(spark, f"{place}/again/model")[1], 384).collect()}
    assert rows["num_files"] == "8 *(--files-from reused the sample; --num-files=1500 ignored)*" and rows["tokens analyzed"] == "384"


def test_holdout_document(spark, place):
    before = store.read_text(spark, f"{place}/one/sample.json")
    found = programs.holdout_run(spark, HoldoutConfig(f"{place}/one", num_files=5, seed=3))
    rows, run, _ = store.load_model(spark, f"{place}/one/model")
    trained, model = set(run.first()["files"]), programs.model_from(rows)
    files = store.read_json(spark, f"{place}/one/holdout/files.json")["files"]
    manifest = store.manifest(spark, f"{place}/one/holdout/sample.json").first()
    assert len(files) == 5 and not trained & set(files) and files == sorted(files) == manifest["files"] and manifest["tokens_per_file"] == CELLS
    assert store.read_text(spark, f"{place}/one/sample.json") == before
    x = np.concatenate([features()[f * CELLS : (f + 1) * CELLS] for f in files]).astype(float)
    r, away = model.residuals(x)
    best, at = r.argmin(axis=1), np.arange(len(x))
    w = model.counts / model.counts.sum()
    centre = w @ model.means
    held, inside = found["holdout"], found["in_sample"]
    assert found["num_holdout_files"] == 5 and found["num_holdout_tokens"] == len(x)
    assert held["total"] == pytest.approx(((x - centre) ** 2).sum(axis=1).mean()) and held["residual"] == pytest.approx(np.maximum(r.min(axis=1), 0).mean())
    assert held["within"] == pytest.approx(away[at, best].mean()) and held["captured"] == pytest.approx((away - r)[at, best].mean())
    assert held["residual_frac"] == pytest.approx(held["residual"] / held["total"]) and held["modeled_frac"] == pytest.approx(1 - held["residual_frac"])
    total = w @ model.trace + w @ ((model.means - centre) ** 2).sum(axis=1)
    assert inside["total"] == pytest.approx(total) and inside["residual"] == pytest.approx(w @ (model.trace - model.eigvals.sum(axis=1)))
    assert inside["final_obj_per_token"] == run.first()["final_obj_per_token"]
    assert programs.holdout_run(spark, HoldoutConfig(f"{place}/one", num_files=5, seed=3)) == found
    assert store.load_holdout(spark, f"{place}/one/holdout.json").schema == schema.HOLDOUT


def test_objective_falls_back_to_the_history(spark):
    run = lambda final: spark.createDataFrame([("f", {"method": "x"}, [1], final)], schema.RUN)
    history = spark.createDataFrame([(2, 5.0), (10, 3.0), (1, 9.0)], "iter int, obj_per_token double")
    assert [holdout.objective_of(run(f), h).first()[0] for f, h in ((7.5, history), (None, history), (None, history.where("false")))] == [7.5, 3.0, None]


def test_nothing_left_to_hold_out(spark, place):
    programs.fit_run(spark, f"{place}/tokens", LoadConfig(num_files=FILES, dim=WIDTH, n_cells=CELLS), FitConfig(clusters=2, dim=0, iters=1), f"{place}/all")
    with pytest.raises(ValueError, match="none is left"):
        programs.holdout_run(spark, HoldoutConfig(f"{place}/all"))


def test_reports(spark, place):
    programs.holdout_run(spark, HoldoutConfig(f"{place}/one", num_files=2))
    text = cli.run(spark, cli.parser().parse_args(["analyze", "--dir", f"{place}/one", "--top-pairs", "2"]))
    assert text.rstrip("\n") == store.read_text(spark, f"{place}/one/report.md").rstrip("\n")
    for head in ("Configuration", "Token sample", "Convergence", "Global variance decomposition", "Held-out generalization", "Clusters (sorted by size)", "Subspace affinity between clusters"):
        assert f"\n## {head}\n" in text
    named = store.manifest(spark, f"{place}/one/sample.json").first()["fingerprint"]
    assert f"`{named}`" in text and "| clusters | 3 |" in text and "| num_files | 8 |" in text and "| tokens analyzed | 384 |" in text
    months = cli.run(spark, cli.parser().parse_args(["temporal", "--dir", f"{place}/one", "--top-seasonal", "2", "--out", f"{place}/months.md"]))
    assert "## Month-to-month stability" in months and "map_month_12" in months and store.exists(spark, f"{place}/months.md")
    assert store.read_text(spark, f"{place}/one/maps/map_annual.svg").startswith("<svg")


def test_printed_rows_as_in_a_full_size_report(spark):
    """Rows of a real run's history and settings, and how a report of it prints them."""
    history = spark.createDataFrame([(1, 7659.1961, 1.0, 127, 23702502), (25, 1888.5121, 0.0155, 227886, 1478211)], "iter int, obj_per_token double, frac_changed double, size_min long, size_max long")
    assert report.table(report.convergence(history)).split("\n") == [
        "| iter | objective/token | labels changed | min size | max size |", "|---|---|---|---|---|", "| 1 | 7659.20 | 100.00% | 127 | 23,702,502 |", "| 25 | 1888.51 | 1.55% | 227,886 | 1,478,211 |",
    ]
    config = {"src": "latents_2", "num_files": "1500", "files_from": "older/sample.json", "tokens_per_file": "12288", "clusters": "128", "dim": "64", "iters": "25", "tol": "0.001", "linear": "False", "seed": "0", "chunk_size": "262144", "gpus": "2"}
    run = spark.createDataFrame([("82ca602ed7e7", config, list(range(7000)), None)], schema.RUN)
    rows = [(r["parameter"], r["value"]) for r in report.configuration(run, 86016000).orderBy("place").collect()]
    assert rows == [("src", "latents_2"), ("num_files", "7000 *(--files-from reused the sample; --num-files=1500 ignored)*"), *((k, config[k]) for k in report.SETTINGS[2:]), ("tokens analyzed", "86,016,000")]
    lines = report.variance_lines({"total": 5998.6, "between_share": 0.0842, "captured_share": 0.6013, "residual_share": 0.3148}, 64, 0.65, {"least": 18, "median": 33, "most": 40})
    assert "**5999**" in lines[0] and "- **8.4%** between clusters" in lines and any(x.startswith("- **60.1%** captured") for x in lines) and "- **31.5%** residual" in lines and "min 18 / median 33 / max 40" in lines[-1]
    told = report.holdout_lines({"num_holdout_files": 200, "num_holdout_tokens": 2457600, "holdout": {"residual_frac": 0.31494, "residual": 1887.16}, "in_sample": {"residual_frac": 0.31475, "final_obj_per_token": 1888.512}})
    assert told[0].startswith("2,457,600 tokens of 200 files") and "| in-sample | 31.5% |" in told and "| generalization gap | +0.0% |" in told and "**1888.51** vs held-out **1887.16**" in told[-1] and "generalises" in told[-1]


def test_runs_are_compared(spark, place):
    folders = {"one": f"{place}/one", "again": f"{place}/again", "two": f"{place}/two"}
    cards = {r["name"]: r for r in programs.run_cards(spark, folders).collect()}
    assert cards["one"]["objective"] == cards["again"]["objective"] and cards["one"]["fingerprint"] == cards["again"]["fingerprint"] != cards["two"]["fingerprint"]
    found = {(r["run_a"], r["run_b"]): r for r in compare.agreements(compare.run_pairs(programs.joined_labels(spark, folders), list(folders))).collect()}
    assert found["one", "again"]["nmi"] == pytest.approx(1) and found["one", "again"]["tokens"] == 8 * CELLS
    both = set(store.load_model(spark, folders["one"] + "/model")[1].first()["files"]) & set(store.load_model(spark, folders["two"] + "/model")[1].first()["files"])
    assert found.get(("one", "two"), {"tokens": 0})["tokens"] == len(both) * CELLS


def test_flags_and_their_defaults():
    args = cli.parser().parse_args(["fit", "--src", "t"])
    assert (args.out, args.num_files, args.tokens_per_file, args.clusters, args.dim, args.iters, args.tol, args.linear, args.seed) == ("subspace_out", 1500, 12288, 64, 16, 25, 1e-3, False, 0)
    held = cli.parser().parse_args(["holdout", "--dir", "r"])
    assert (held.num_files, held.seed, held.src) == (200, 12345, None)
    assert cli.parser().parse_args(["analyze"]).top_pairs == 12 and cli.parser().parse_args(["temporal"]).top_seasonal == 8
    assert cli.parser().parse_args("fit --src t -K 128 -d 64 --linear".split()).clusters == 128


def test_write_table_command(spark, tmp_path):
    spark.createDataFrame([(3, 0, [1.0, 2.0])], schema.TOKENS).write.parquet(f"{tmp_path}/raw")
    cli.run(spark, cli.parser().parse_args(f"write-table --src {tmp_path}/raw --out {tmp_path}/t".split()))
    assert spark.read.parquet(f"{tmp_path}/t").where(F.col("folder") == 3).count() == 1
