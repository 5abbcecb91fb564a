"""Calendar aggregates: one month x cell x cluster cube, from which the rest is rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.calendar import month_of
from orrery.operators.spatial import clusters, dominant, enrichment, variation


def cube(assigned: DataFrame, *more: Column) -> DataFrame:
    """(month, cell_id, label, n, and further aggregates); persist it where several reports read it."""
    return assigned.groupBy(month_of(F.col("file_id")).alias("month"), "cell_id", "label").agg(F.count(F.lit(1)).alias("n"), *more)


def monthly_dominant(months: DataFrame) -> DataFrame:
    return dominant(months, "month", "cell_id")


def annual_dominant(months: DataFrame) -> DataFrame:
    return dominant(months.groupBy("cell_id", "label").agg(F.sum("n").alias("n")), "cell_id")


def month_rollup(months: DataFrame) -> DataFrame:
    """(month, label, n) with subtotals: null label for a month's total, null month for all."""
    return months.rollup("month", "label").agg(F.sum("n").alias("n"))


def files_per_month(files: DataFrame) -> DataFrame:
    """(month, files), all twelve months."""
    counted = files.select("file_id").distinct().groupBy(month_of(F.col("file_id")).alias("month")).agg(F.count(F.lit(1)).alias("files"))
    months = files.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(counted, "month", "left").select("month", F.coalesce("files", F.lit(0)).cast("long").alias("files"))


def monthly_enrichment(months: DataFrame, k: int) -> DataFrame:
    return enrichment(months.groupBy("month", "label").agg(F.sum("n").alias("n")), "month", k)


def monthly_profile(months: DataFrame, k: int) -> DataFrame:
    """A column a month; null where a month has no data."""
    wide = monthly_enrichment(months, k).groupBy("label").pivot("month", list(range(1, 13))).agg(F.first("enrichment"))
    return wide.select("label", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def seasonality(months: DataFrame, k: int) -> DataFrame:
    return variation(monthly_enrichment(months, k)).withColumnRenamed("cv", "seasonality")


def top_seasonal(months: DataFrame, k: int, top: int = 8) -> DataFrame:
    return seasonality(months, k).orderBy(F.desc(F.round("seasonality", 9)), "label").limit(top)


def flip_rates(months: DataFrame) -> DataFrame:
    """(month, both, flips, rate): cells with data in a month and the next whose dominant cluster changes; 11 pairs, null without such cells."""
    best = monthly_dominant(months).select("month", "cell_id", "label")
    after = best.select((F.col("month") - 1).alias("month"), "cell_id", F.col("label").alias("next"))
    pairs = best.join(after, ["month", "cell_id"]).groupBy("month").agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("label") != F.col("next")).alias("flips"))
    spine = months.sparkSession.range(1, 12).select(F.col("id").cast("int").alias("month"))
    out = spine.join(pairs, "month", "left").na.fill(0, ["both", "flips"])
    return out.select("month", "both", "flips", F.when(F.col("both") > 0, F.col("flips") / F.col("both")).alias("rate"))


def flip_summary(months: DataFrame) -> DataFrame:
    return flip_rates(months).agg(F.min("rate").alias("least"), F.avg("rate").alias("mean"), F.max("rate").alias("most"))


def shift(months: DataFrame, a: int = 1, b: int = 7) -> DataFrame:
    """(both, flips, rate) between two months."""
    best = monthly_dominant(months)
    one, two = (best.where(F.col("month") == m).select("cell_id", F.col("label").alias(n)) for m, n in ((a, "x"), (b, "y")))
    found = one.join(two, "cell_id").agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("x") != F.col("y")).alias("flips"))
    return found.select("both", "flips", F.when(F.col("both") > 0, F.col("flips") / F.col("both")).alias("rate"))


def owned_delta(months: DataFrame, k: int, a: int = 1, b: int = 7, top: int = 5) -> DataFrame:
    """(label, before, after, delta): the clusters that gain most cells from one month to another."""
    best = monthly_dominant(months)
    owned = lambda m, n: best.where(F.col("month") == m).groupBy("label").agg(F.count(F.lit(1)).alias(n))
    rows = clusters(months, k).join(owned(a, "before"), "label", "left").join(owned(b, "after"), "label", "left").na.fill(0, ["before", "after"])
    return rows.withColumn("delta", F.col("after") - F.col("before")).orderBy(F.desc("delta"), "label").limit(top)


def dash(value, form: str = "{:.2f}") -> str:
    """A number for a report; null as a dash."""
    return "–" if value is None else form.format(value)
