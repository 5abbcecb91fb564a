"""A frozen model on tokens it wasn't fitted to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.subspaces import Model, assigned
from orrery.operators.variance import GAP, decomposition


def replay(tokens: DataFrame, model: Model) -> DataFrame:
    """(n, residual, within, captured) sums; residual and captured are clamped at zero by token."""
    rows = assigned(tokens, model)
    zero = F.lit(0.0)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest("residual", zero)).alias("residual"), F.sum(F.greatest("within", zero)).alias("within"),
        F.sum(F.greatest(F.col("within") - F.greatest("residual", zero), zero)).alias("captured"),
    )


def document(found: DataFrame, rows: DataFrame, files: int, objective: DataFrame, linear: bool = False) -> DataFrame:
    """The nested result of an evaluation: sums per token beside the in-sample decomposition and the objective (one row each)."""
    inside = decomposition(rows, linear).select("total", "residual", F.col("residual_share").alias("residual_frac"))
    per_token = [(F.col(f"held.{c}") / F.col("held.n")).alias(c) for c in ("total", "residual", "within", "captured")]
    row = found.alias("held").crossJoin(inside.alias("inside")).crossJoin(objective.select("final_obj_per_token"))
    held = F.struct(*per_token, F.col("held.held_out").alias("residual_frac"), F.col("held.modeled").alias("modeled_frac"))
    return row.select(F.lit(files).alias("num_holdout_files"), F.col("held.n").alias("num_holdout_tokens"), held.alias("holdout"), F.struct("inside.total", "inside.residual", "inside.residual_frac", "final_obj_per_token").alias("in_sample"))


def objective_of(run: DataFrame, history: DataFrame) -> DataFrame:
    """(final_obj_per_token): of the run's last assignment, else the last of its history, else null."""
    last = history.agg(F.max_by("obj_per_token", "iter").alias("last"))
    return run.select(F.col("final_obj_per_token").alias("final")).limit(1).crossJoin(last).select(F.coalesce("final", "last").alias("final_obj_per_token"))  # one row each


def evaluate(tokens: DataFrame, model: Model, rows: DataFrame) -> DataFrame:
    """One row: tokens, held-out residual share of the variance about the model's mean, in-sample share, gap, verdict."""
    overall = (model.means * model.counts[:, None]).sum(axis=0) / max(model.counts.sum(), 1) * (0 if model.linear else 1)
    centre = F.array(*[F.lit(float(v)) for v in overall])
    total = tokens.agg(F.sum(F.aggregate(F.zip_with("features", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("total"))
    inside = decomposition(rows, model.linear).select(F.col("residual_share").alias("in_sample"))
    out = replay(tokens, model).crossJoin(total).crossJoin(inside)  # one row each
    out = out.withColumn("held_out", F.col("residual") / F.greatest("total", F.lit(1e-12)))
    return out.withColumn("modeled", 1 - F.col("held_out")).withColumn("gap", F.col("held_out") - F.col("in_sample")).withColumn("verdict", F.when(F.col("gap") > GAP, "overfit").otherwise("generalizes"))
