"""Variance reports over a model table (one row a cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import squared_norm

#: A gap between held-out and in-sample residual shares above this is overfitting.
GAP = 0.03


def weights(model: DataFrame) -> DataFrame:
    return model.select("cluster", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("w"))


def global_mean(model: DataFrame) -> DataFrame:
    """(dim, value): means weighted by cluster sizes."""
    long = model.join(weights(model).select("cluster", "w"), "cluster").select("w", F.posexplode("mean").alias("dim", "v"))
    return long.groupBy("dim").agg(F.sum(F.col("w") * F.col("v")).alias("value"))


def decomposition(model: DataFrame, linear: bool = False) -> DataFrame:
    """One row: between, within, total, captured, residual and their shares of the total."""
    mean = global_mean(model).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("g"))
    rows = model.join(weights(model).select("cluster", "w"), "cluster").crossJoin(F.broadcast(mean))  # one row
    away = squared_norm(F.zip_with("mean", "g", lambda a, b: a - b)) if not linear else F.lit(0.0)
    caught = F.aggregate("eigvals", F.lit(0.0), lambda s, x: s + x)
    sums = rows.agg(F.sum(F.col("w") * away).alias("between"), F.sum(F.col("w") * F.col("trace")).alias("within"), F.sum(F.col("w") * caught).alias("captured"))
    sums = sums.withColumn("total", F.col("between") + F.col("within")).withColumn("residual", F.col("within") - F.col("captured"))
    share = {f"{c}_share": F.col(c) / F.greatest("total", F.lit(1e-12)) for c in ("between", "captured", "residual")}
    return sums.withColumns(share)


def weighted_evr(model: DataFrame) -> DataFrame:
    evr = F.aggregate("eigvals", F.lit(0.0), lambda s, x: s + x) / F.greatest("trace", F.lit(1e-12))
    return model.select("n", evr.alias("evr")).agg((F.sum(F.col("n") * F.col("evr")) / F.sum("n")).alias("evr"))


def effective_dims(model: DataFrame, share: float = 0.8) -> DataFrame:
    """(cluster, d80): axes that hold ``share`` of the captured variance; one more than there are if nothing is captured."""
    long = model.select("cluster", F.posexplode("eigvals").alias("i", "e"))
    upto = Window.partitionBy("cluster").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    all_of = F.greatest(F.sum("e").over(Window.partitionBy("cluster")), F.lit(1e-12))
    marked = long.select("cluster", (F.sum("e").over(upto) / all_of).alias("cum"))
    return marked.groupBy("cluster").agg((F.count_if(F.col("cum") < share) + 1).cast("long").alias("d80"))


def dims_summary(dims: DataFrame) -> DataFrame:
    """Least, lower median and most."""
    return dims.agg(F.min("d80").alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d80)").alias("median"), F.max("d80").alias("most"))



def verdicts(rows: DataFrame, gap: float = GAP) -> DataFrame:
    """Rows with held_out and in_sample residual shares: gap and verdict."""
    return rows.withColumn("gap", F.col("held_out") - F.col("in_sample")).withColumn("verdict", F.when(F.col("gap") > gap, "overfit").otherwise("generalizes"))
