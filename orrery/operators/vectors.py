"""Token-level distances in relational form: exact and engine-independent; the fit uses blocked products instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import dot, squared_norm, unit


def centroids(tokens: DataFrame) -> DataFrame:
    """(cluster, n, mean) of labelled tokens; sums are partial before the shuffle."""
    long = tokens.select("label", F.posexplode("features").alias("dim", "v"))
    means = long.groupBy("label", "dim").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    packed = means.groupBy("label").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("p"))
    return packed.select(F.col("label").cast("int").alias("cluster"), "n", F.transform("p", lambda x: x["m"]).alias("mean"))


def squared_norms(tokens: DataFrame) -> DataFrame:
    return tokens.select("token_id", squared_norm(F.col("features")).alias("sq"))


def against_centroids(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """(token_id, label, cluster, dot, residual): every token with every cluster; the model has one row a cluster."""
    rows = tokens.withColumn("sq", squared_norm(F.col("features"))).crossJoin(F.broadcast(model.withColumn("mean_sq", squared_norm(F.col("mean"))).select("cluster", "mean", "mean_sq")))
    product = dot(F.col("features"), F.col("mean"))
    return rows.withColumn("dot", product).select("token_id", "label", "cluster", "dot", (F.col("sq") - 2 * F.col("dot") + F.col("mean_sq")).alias("residual"))


def nearest(distances: DataFrame) -> DataFrame:
    """(token_id, label, cluster, residual): the least raw residual, the least cluster on ties."""
    best = distances.groupBy("token_id", "label").agg(F.min(F.struct("residual", "cluster")).alias("best"))
    return best.select("token_id", "label", "best.cluster", "best.residual")


def assign_in_row(rows: DataFrame, model: DataFrame, places: int = 9) -> DataFrame:
    """All columns of ``rows`` (with features), and cluster and residual of the nearest mean: no row is multiplied or shuffled.

    The model (cluster, mean) is packed into one broadcast row, so it has to be of bounded size.  Residuals are compared
    at ``places`` decimals, the least cluster wins ties; both columns are null under a model without rows.
    """
    packed = model.agg(F.sort_array(F.collect_list(F.struct("cluster", "mean"))).alias("model_"))
    gap = lambda m: F.aggregate(F.zip_with("features", m["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("model_", lambda m: F.struct(F.round(gap(m), places).alias("residual"), m["cluster"].alias("cluster"))))
    out = rows.crossJoin(F.broadcast(packed)).withColumn("best_", best)  # one row
    return out.withColumns({"cluster": F.col("best_.cluster"), "residual": F.col("best_.residual")}).drop("model_", "best_")


def objective(best: DataFrame) -> DataFrame:
    """(n, objective, per_token): residuals under zero count as zero."""
    return best.agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("residual", F.lit(0.0))).alias("objective"), F.avg(F.greatest("residual", F.lit(0.0))).alias("per_token"))


def labels_changed(best: DataFrame) -> DataFrame:
    return best.agg(F.count_if(F.col("label") != F.col("cluster")).alias("changed"), F.avg((F.col("label") != F.col("cluster")).cast("double")).alias("frac_changed"))


def unit_vectors(tokens: DataFrame) -> DataFrame:
    return tokens.select("token_id", unit(F.col("features")).alias("features"))
