"""Agreement of two labellings and of neighbouring cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, na, nb, total): at most labels x labels rows after one aggregate."""
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b")), "total": F.sum("n").over(Window.partitionBy())})


def _entropy(rows: DataFrame, by: str, n: str) -> DataFrame:
    p = F.col(n) / F.col("total")
    return rows.select(by, n, "total").distinct().agg((-F.sum(p * F.log(p))).alias(f"h_{by}"))


def nmi(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(nmi): mutual information over the arithmetic mean of the entropies; 1 for two constant labellings."""
    table = contingency(rows, a, b)
    mutual = table.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n").cast("double") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))).alias("mi"))
    both = mutual.crossJoin(_entropy(table, "a", "na")).crossJoin(_entropy(table, "b", "nb"))  # one row each
    mean = (F.col("h_a") + F.col("h_b")) / 2
    return both.select(F.when(mean > 0, F.col("mi") / mean).otherwise(1.0).alias("nmi"))


def ari(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): adjusted Rand index; 1 where it isn't defined because both labellings are trivial."""
    table = contingency(rows, a, b)
    choose = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    cells = table.agg(F.sum(choose("n")).alias("s"), F.max(choose("total")).alias("t"))
    x = table.select("a", "na").distinct().agg(F.sum(choose("na")).alias("x"))
    y = table.select("b", "nb").distinct().agg(F.sum(choose("nb")).alias("y"))
    row = cells.crossJoin(x).crossJoin(y)  # one row each
    expected, most = F.col("x") * F.col("y") / F.col("t"), (F.col("x") + F.col("y")) / 2
    return row.select(F.when(most != expected, (F.col("s") - expected) / (most - expected)).otherwise(1.0).alias("ari"))


def neighbour_agreement(dominant: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(pairs, agreement, times_chance): neighbouring cells with the same dominant cluster."""
    a, b = dominant.select(F.col("cell_id").alias("a"), F.col("label").alias("x")), dominant.select(F.col("cell_id").alias("b"), F.col("label").alias("y"))
    pairs = edges.join(a, "a").join(b, "b")
    rate = F.avg((F.col("x") == F.col("y")).cast("double"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), rate.alias("agreement"), (rate * k).alias("times_chance"))


def count_mismatches(model: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, saved, found): clusters whose saved count isn't the number of their labels."""
    found = assigned.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("found"))
    rows = model.select("cluster", F.col("n").alias("saved")).join(found, "cluster", "full_outer").na.fill(0, ["saved", "found"])
    return rows.where(F.col("saved") != F.col("found"))


def comparable_runs(runs: DataFrame) -> DataFrame:
    """(fingerprint, runs, names): runs on the same sample."""
    return runs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("runs"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def run_summary(name: str, history: DataFrame, variance: DataFrame) -> DataFrame:
    """One row of a table that compares runs; union them."""
    last = history.orderBy(F.desc("iter")).limit(1).select("iter", "obj_per_token", "frac_changed")
    return last.crossJoin(variance.select("between_share", "captured_share", "residual_share")).select(F.lit(name).alias("name"), "*")  # one row each


def run_pairs(rows: DataFrame, runs: list[str]) -> DataFrame:
    """(run_a, run_b, a, b, n): how often two runs' labels meet, of all pairs of runs in one aggregate.

    ``rows`` has a label column for each run (an array of labels a token); every token gives its pairs, which are summed
    before the shuffle.  Tokens without a label in one of two runs don't count for them.
    """
    label = {r: F.col(f"`{r}`").cast("int") for r in runs}
    pairs = [F.struct(F.lit(x).alias("run_a"), F.lit(y).alias("run_b"), label[x].alias("a"), label[y].alias("b")) for i, x in enumerate(runs) for y in runs[i + 1 :]]
    flat = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("a is not null and b is not null")
    return flat.groupBy("run_a", "run_b", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def agreements(pairs: DataFrame) -> DataFrame:
    """(run_a, run_b, tokens, nmi, ari) of each pair in ``run_pairs``; both are 1 where they aren't defined because both labellings are trivial."""
    by = ("run_a", "run_b")
    choose = lambda n: n.cast("double") * (n - 1) / 2
    sides = {s: pairs.groupBy(*by, s).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(F.col("m") * F.log("m")).alias(f"log_{s}"), F.sum(choose(F.col("m"))).alias(f"pairs_{s}")) for s in ("a", "b")}
    both = pairs.groupBy(*by).agg(F.sum("n").alias("tokens"), F.sum(F.col("n") * F.log("n")).alias("log_ab"), F.sum(choose(F.col("n"))).alias("pairs_ab"))
    rows = both.join(sides["a"], [*by]).join(sides["b"], [*by])  # one row a pair of runs
    t = F.col("tokens")
    entropy = {s: F.log(t) - F.col(f"log_{s}") / t for s in ("a", "b", "ab")}
    mean = (entropy["a"] + entropy["b"]) / 2
    expected, most = F.col("pairs_a") * F.col("pairs_b") / choose(t), (F.col("pairs_a") + F.col("pairs_b")) / 2
    nmi_ = F.when(mean > 1e-12, (entropy["a"] + entropy["b"] - entropy["ab"]) / mean).otherwise(1.0)
    ari_ = F.when((t > 1) & (most != expected), (F.col("pairs_ab") - expected) / F.nullif(most - expected, F.lit(0.0))).otherwise(1.0)
    return rows.select(*by, "tokens", nmi_.alias("nmi"), ari_.alias("ari"))


def run_card(name: str, model: DataFrame, history: DataFrame, assigned: DataFrame, least: int, final_obj_per_token: float | None = None, linear: bool = False) -> DataFrame:
    """One row of the table that compares runs: objective, variance split, explained shares, axes, sizes and seasons; union them.

    The objective is that of the last assignment if it is known, else the last of the history.
    """
    from orrery.operators import temporal, variance

    middle = lambda c, name: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(name)
    last = history.orderBy(F.desc("iter")).limit(1).select(F.coalesce(F.lit(final_obj_per_token).cast("double"), F.col("obj_per_token")).alias("objective"))
    split = variance.decomposition(model, linear).select("between_share", "captured_share", "residual_share")
    evr = model.agg(F.min("evr").alias("evr_least"), middle("evr", "evr_median"), F.max("evr").alias("evr_most"), F.min("n").alias("smallest"), F.count_if(F.col("n") < least).alias("tiny"))
    dims = variance.effective_dims(model).agg(F.max("d80").alias("most_d80"))
    months = temporal.cube(assigned)
    flips = temporal.flip_summary(months).select(F.col("least").alias("flip_least"), F.col("mean").alias("flip_mean"), F.col("most").alias("flip_most"))
    moved = temporal.shift(months).select(F.col("rate").alias("jan_jul"))
    out = last
    for one in (split, evr, dims, flips, moved):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out.select(F.lit(name).alias("name"), "*")
