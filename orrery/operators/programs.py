"""The four programs over a run folder: fit, report, report by months, hold-out evaluation.

A run folder has sample.json, model (clusters, run, history), assignments, and what the reports and the hold-out
evaluation add: report.md, temporal_report.md, maps, holdout.json and, for the manifest of held-out files, holdout.
"""

from __future__ import annotations

from dataclasses import asdict, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import healpix
from orrery.operators import affinity, holdout, render, report, sampling, temporal, variance
from orrery.operators.subspaces import Model, assigned, fit, model_from
from orrery.sources import schema as S
from orrery.sources import store
from orrery.sources.load import folders_of, load_tokens


def fit_run(spark: SparkSession, src: str, load: S.LoadConfig, cfg: S.FitConfig, out: str) -> Model:
    """Loads a sample of the token table ``src``, fits it, and writes the run folder."""
    loaded = load_tokens(spark, src, load, out)
    tokens = loaded.tokens.select("file_id", "cell_id", "features").persist()
    try:
        model = fit(tokens, cfg)
        config = cfg.as_map() | {k: str(v) for k, v in asdict(load).items() if k != "seed"} | {"src": src}
        run = spark.createDataFrame([(loaded.fingerprint, config, loaded.files, model.final_obj_per_token)], S.RUN)
        history = spark.createDataFrame(model.history).select([f.name for f in S.HISTORY])
        store.save_model(model.rows(spark), run, history, f"{out}/model")
        store.save_assignments(assigned(tokens, model).select("file_id", "cell_id", "label"), f"{out}/assignments")
    finally:
        tokens.unpersist()
    return model


def _opened(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, dict, list[int], str, Model]:
    rows, run, history = store.load_model(spark, f"{folder}/model")
    row = run.first()
    config = dict(row["config"])
    return rows, run, history, config, list(row["files"]), row["fingerprint"], model_from(rows, config.get("linear") == "True")


def _number(config: dict, name: str, otherwise: int | None = None) -> int | None:
    value = config.get(name, "None")
    return otherwise if value == "None" else int(value)


def analyze_run(spark: SparkSession, cfg: S.AnalyzeConfig) -> str:
    """The clustering report of a run folder, written to ``out`` (report.md in the folder); writes a missing manifest too."""
    rows, run, history, config, files, named, model = _opened(spark, cfg.dir)
    labels = store.load_assignments(spark, f"{cfg.dir}/assignments").persist()
    try:
        n_tokens, k = labels.count(), len(model.means)
        n_cells = _number(config, "n_cells", S.N_CELLS)
        n_files = _number(config, "n_files_total", S.N_FILES)
        store.backfill_manifest(spark, run, f"{cfg.dir}/sample.json", _number(config, "tokens_per_file"), _number(config, "seed", 0), config.get("src"))
        table = report.table
        parts = [f"# Clustering report ({config['method']}) — `{cfg.dir}`", f"*K={k} {f'affine subspaces of dim {model.dim}' if model.dim else 'point clusters'} in {model.means.shape[1]}-dim token space, {n_tokens:,} tokens.*"]
        parts += ["## Configuration", table(report.configuration(run, n_tokens).orderBy("place").select("parameter", "value"))]
        parts += ["## Token sample", "\n".join(report.sample_lines(named, files, config.get("tokens_per_file", "None"), config.get("seed", "0")))]
        parts += ["## Convergence", table(report.convergence(history.orderBy("iter")))]
        split, evr = variance.decomposition(rows, model.linear).first().asDict(), variance.weighted_evr(rows).first()["evr"]
        dims = variance.dims_summary(variance.effective_dims(rows)).first().asDict() if model.dim else None
        parts += ["## Global variance decomposition", "\n".join(report.variance_lines(split, model.dim, evr, dims))]
        if store.exists(spark, f"{cfg.dir}/holdout.json"):
            parts += ["## Held-out generalization", "\n".join(report.holdout_lines(store.load_holdout(spark, f"{cfg.dir}/holdout.json").first().asDict(True)))]
        parts += ["## Clusters (sorted by size)", table(report.cluster_table(rows, labels, k, n_cells, n_files), 2)]
        if model.dim:
            pairs = affinity.subspace_affinity(spark, model)
            parts += ["## Subspace affinity between clusters", table(affinity.affinity_stats(pairs)), table(affinity.top_pairs(pairs, cfg.top_pairs))]
    finally:
        labels.unpersist()
    text = "\n\n".join(parts) + "\n"
    store.write_text(spark, text, cfg.out or f"{cfg.dir}/report.md")
    return text


def temporal_run(spark: SparkSession, cfg: S.TemporalConfig) -> str:
    """The report by months of a run folder, and thirteen maps below ``maps`` where the cells are a HEALPix grid."""
    _, _, _, config, files, _, model = _opened(spark, cfg.dir)
    labels, k = store.load_assignments(spark, f"{cfg.dir}/assignments"), len(model.means)
    months = temporal.cube(labels).persist()
    try:
        listed = spark.createDataFrame([(f,) for f in files], "file_id int")
        table = report.table
        seasonal = temporal.top_seasonal(months, k, cfg.top_seasonal).join(temporal.monthly_profile(months, k), "label").orderBy(F.desc("seasonality"), "label")
        parts = [f"# Temporal & spatial report — `{cfg.dir}`", "## Time axis", "Files are six-hour steps from 2014-01-01 00:00.", table(temporal.files_per_month(listed).orderBy("month"))]
        drawn = _maps(spark, cfg, config, model, months)
        if drawn:
            parts += ["## Maps", "\n".join(f"- [{name}]({path})" for name, path in drawn)]
        parts += ["## Most seasonal clusters", table(seasonal, 2), "## Month-to-month stability", table(temporal.flip_rates(months).orderBy("month"), 3), table(temporal.flip_summary(months)), "## Jan ↔ Jul", table(temporal.shift(months)), table(temporal.owned_delta(months, k))]
    finally:
        months.unpersist()
    text = "\n\n".join(parts) + "\n"
    store.write_text(spark, text, cfg.out or f"{cfg.dir}/temporal_report.md")
    return text


def _maps(spark: SparkSession, cfg: S.TemporalConfig, config: dict, model: Model, months: DataFrame) -> list[tuple[str, str]]:
    n_cells = _number(config, "n_cells", S.N_CELLS)
    nside = int(round((n_cells / 12) ** 0.5))
    if 12 * nside * nside != n_cells or nside & (nside - 1):
        return []
    colours = affinity.colours(affinity.affinity_matrix(model))
    lines = [np.array(r["points"]) for r in store.coastlines(spark, cfg.coastlines).collect()] if cfg.coastlines else []
    places = F.broadcast(healpix.cells(spark, nside))  # 12 nside^2 rows, as have all frames below
    by_month = temporal.monthly_dominant(months).join(places, "cell_id").persist()
    out = []
    try:
        for name, best in [("annual", temporal.annual_dominant(months).join(places, "cell_id")), *((f"month_{m:02d}", by_month.where(F.col("month") == m)) for m in range(1, 13))]:
            path = f"{cfg.dir}/maps/map_{name}.svg"
            store.write_text(spark, render.world_map(best, colours, nside, name, lines, cfg.degrees, cfg.heatmap), path)
            out.append((name, path))
    finally:
        by_month.unpersist()
    return out


def holdout_run(spark: SparkSession, cfg: S.HoldoutConfig) -> dict:
    """Replays a run's frozen model on files it wasn't fitted to; writes holdout.json, and their list and manifest below ``holdout``.

    The run's own manifest stays as it is.  Held-out files give all their tokens.
    """
    rows, run, history, config, trained, _, model = _opened(spark, cfg.dir)
    src = cfg.src or config["src"]
    total = _number(config, "n_files_total")
    every = spark.range(total).select(F.col("id").cast("int").alias("file_id")) if total is not None else folders_of(spark, src)
    pool = sampling.holdout_pool(every, spark.createDataFrame([(f,) for f in trained], "file_id int"), cfg.num_files, cfg.seed)
    files = sorted(r["file_id"] for r in pool.collect())  # the files of the evaluation
    if not files:
        raise ValueError("every file was used in the fit: none is left to hold out")
    listed = f"{cfg.dir}/holdout/files.json"
    store.write_json(spark, {"files": files}, listed)
    load = S.LoadConfig(num_files=len(files), seed=cfg.seed, dim=model.means.shape[1], n_cells=_number(config, "n_cells"), tokens_per_file=_number(config, "n_cells"), files_from=listed, files_per_folder=_number(config, "files_per_folder", 1), max_bytes=cfg.max_bytes)
    tokens = load_tokens(spark, src, load, f"{cfg.dir}/holdout").tokens.withColumn("features", F.col("features").cast("array<double>"))
    found = holdout.evaluate(tokens, model, rows)
    store.save_holdout(holdout.document(found, rows, len(files), holdout.objective_of(run, history), model.linear), f"{cfg.dir}/holdout.json")
    return store.load_holdout(spark, f"{cfg.dir}/holdout.json").first().asDict(True)


def run_cards(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """The table that compares runs by name: one card each."""
    from orrery.operators import compare

    out = None
    for name, folder in folders.items():
        rows, run, history, config, _, named, model = _opened(spark, folder)
        cfg = replace(S.FitConfig(), dim=model.dim, min_count=_number(config, "min_count"))
        labels = store.load_assignments(spark, f"{folder}/assignments")
        card = compare.run_card(name, rows, history, labels, cfg.least, run.first()["final_obj_per_token"], model.linear).withColumn("fingerprint", F.lit(named))
        out = card if out is None else out.union(card)
    return out


def joined_labels(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """file_id, cell_id and a label column for each run, for ``compare.run_pairs``; tokens of any run, null where a run lacks them."""
    parts = None
    for name, folder in folders.items():
        one = store.load_assignments(spark, f"{folder}/assignments").select("file_id", "cell_id", F.lit(name).alias("run"), "label")
        parts = one if parts is None else parts.union(one)
    return parts.groupBy("file_id", "cell_id").pivot("run", list(folders)).agg(F.first("label"))
