"""Markdown reports from small frames; every frame here has one row a cluster, month or pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import affinity as A
from orrery.operators import spatial as S
from orrery.operators import temporal as T
from orrery.operators import variance as V
from orrery.operators.subspaces import Model


def table(df: DataFrame, digits: int = 3) -> str:
    """A frame as a Markdown table; nulls are dashes."""
    show = lambda v: T.dash(v, f"{{:.{digits}f}}") if isinstance(v, float) or v is None else str(v)
    rows = df.collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def cluster_table(model: DataFrame, assigned: DataFrame, k: int, n_cells: int, n_files: int) -> DataFrame:
    """Size, share, explained share, cells, files and temporal variation of each cluster, largest first."""
    cv = S.variation(S.enrichment(S.bucket_counts(assigned, S.decile_of(F.col("file_id"), n_files), "decile"), "decile", k))
    out = V.weights(model).withColumnRenamed("cluster", "label").join(model.select(F.col("cluster").alias("label"), "evr"), "label")
    for more in (S.owned_cells(assigned, k), S.cells_at_half(assigned, k, n_cells), S.file_presence(assigned, k), cv):
        out = out.join(more, "label", "left")
    return out.orderBy(F.desc("n"), "label")


def cluster_report(spark, model: Model, assigned: DataFrame, n_cells: int, n_files: int, config: dict[str, str] | None = None, holdout: DataFrame | None = None) -> str:
    rows = model.rows(spark)
    k = len(model.means)
    parts = ["# Clusters", "## Settings", "\n".join(f"- {a}: {b}" for a, b in (config or {}).items()), "## Convergence"]
    parts.append(table(spark.createDataFrame(model.history).select("iter", "obj_per_token", "frac_changed", "size_min", "size_max", "size_median")) if model.history else "none")
    parts += ["## Variance", table(V.decomposition(rows, model.linear)), table(V.weighted_evr(rows))]
    if model.dim:
        parts.append(table(V.dims_summary(V.effective_dims(rows))))
    if holdout is not None:
        parts += ["## Held-out tokens", table(holdout)]
    parts += ["## Clusters by size", table(cluster_table(rows, assigned, k, n_cells, n_files))]
    pairs = A.subspace_affinity(spark, model)
    parts += ["## Affinity", table(A.affinity_stats(pairs)), table(A.top_pairs(pairs))]
    return "\n\n".join(parts) + "\n"


def temporal_report(assigned: DataFrame, k: int) -> str:
    months = T.cube(assigned).persist()
    try:
        parts = ["# Months", "## Files", table(T.files_per_month(assigned)), "## Most seasonal clusters", table(T.top_seasonal(months, k).join(T.monthly_profile(months, k), "label").orderBy(F.desc("seasonality"), "label"), 2)]
        parts += ["## Changes from month to month", table(T.flip_rates(months)), table(T.flip_summary(months)), "## January to July", table(T.shift(months)), table(T.owned_delta(months, k))]
        return "\n\n".join(parts) + "\n"
    finally:
        months.unpersist()


# The settings a report lists, in this order.
SETTINGS = ("src", "num_files", "tokens_per_file", "clusters", "dim", "iters", "tol", "linear", "seed", "chunk_size", "gpus")


def configuration(run: DataFrame, n_tokens: int) -> DataFrame:
    """(place, parameter, value) of the settings a run has, then the tokens analyzed.

    The number of files is that of the sample; where a manifest gave it, the setting that didn't count is named.
    """
    config, place = F.col("config"), F.posexplode(F.array(*map(F.lit, SETTINGS)))
    rows = run.select(F.size("files").alias("n_files"), "config", place.alias("place", "parameter"))
    given = F.element_at(config, F.col("parameter"))
    reused = F.coalesce(F.element_at(config, F.lit("files_from")), F.lit("None")) != "None"
    note = F.when(reused, F.concat(F.lit(" *(--files-from reused the sample; --num-files="), given, F.lit(" ignored)*"))).otherwise("")
    value = F.when(F.col("parameter") == "num_files", F.concat(F.col("n_files").cast("string"), F.coalesce(note, F.lit("")))).otherwise(given)
    listed = rows.select("place", "parameter", value.alias("value")).where("value is not null")
    return listed.union(run.sparkSession.createDataFrame([(len(SETTINGS), "tokens analyzed", f"{n_tokens:,}")], listed.schema))


def convergence(history: DataFrame) -> DataFrame:
    """The history as it is printed: iter, objective, share of changed labels, least and largest cluster."""
    return history.select(
        "iter", F.format_string("%.2f", "obj_per_token").alias("objective/token"), F.format_string("%.2f%%", F.col("frac_changed") * 100).alias("labels changed"),
        F.format_number("size_min", 0).alias("min size"), F.format_number("size_max", 0).alias("max size"),
    )


def sample_lines(fingerprint: str, files: list[int], per_file: str, seed: str, shown: int = 20) -> list[str]:
    """What makes runs comparable: the sample's fingerprint, its size, and its first files."""
    first = ", ".join(map(str, sorted(files)[:shown])) + (" …" if len(files) > shown else "")
    return [
        f"- **Sample fingerprint:** `{fingerprint}` — runs of the same fingerprint were fitted to the same tokens.",
        f"- **Files:** {len(files)}, {per_file} tokens each, seed {seed}.",
        f"- First files: {first}",
    ]


def variance_lines(parts: dict, dim: int, evr: float, dims: dict | None) -> list[str]:
    share = lambda c: f"{parts[f'{c}_share']:.1%}"
    out = [f"Total variance about the mean of all tokens: **{parts['total']:.0f}**", "", f"- **{share('between')}** between clusters"]
    if dim:
        out += [f"- **{share('captured')}** captured within clusters by {dim} directions", f"- **{share('residual')}** residual", ""]
        out.append(f"Explained share within clusters, by tokens: **{evr:.3f}**. Directions for 80% of what is captured: min {dims['least']} / median {dims['median']} / max {dims['most']} ({dim + 1}: nothing is captured).")
    else:
        out.append(f"- **{share('residual')}** residual, all that is within clusters (points have no directions)")
    return out


def holdout_lines(found: dict) -> list[str]:
    held, inside = found["holdout"], found["in_sample"]
    gap = held["residual_frac"] - inside["residual_frac"]
    number = lambda v: T.dash(v, "{:.2f}")
    return [
        f"{found['num_holdout_tokens']:,} tokens of {found['num_holdout_files']} files the run never saw.", "",
        "| residual (unexplained variance) | fraction |", "|---|---|", f"| in-sample | {inside['residual_frac']:.1%} |", f"| held-out | {held['residual_frac']:.1%} |", f"| generalization gap | {gap:+.1%} |", "",
        f"Objective/token: in-sample **{number(inside['final_obj_per_token'])}** vs held-out **{number(held['residual'])}**. Verdict: **{'overfitting' if gap > V.GAP else 'generalises'}**.",
    ]
