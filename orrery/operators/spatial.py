"""Aggregates over assignments: cells, files and deciles of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.calendar import decile_of

#: More than there are clusters: count and label share one bigint, which keeps the argmax a hash aggregate.
_BASE = 1 << 20


def clusters(df: DataFrame, k: int) -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))


def cell_cluster_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cell_id", "label").agg(F.count(F.lit(1)).alias("n"))


def cells_with_data(assigned: DataFrame) -> DataFrame:
    return assigned.select("cell_id").distinct()


def dominant(counts: DataFrame, *by: str) -> DataFrame:
    """The most frequent label of each group, the least label on ties, and its count."""
    packed = F.max(F.col("n") * _BASE + (_BASE - 1 - F.col("label").cast("long"))).alias("packed")
    best = counts.groupBy(*(by or ("cell_id",))).agg(packed)
    return best.select(*(by or ("cell_id",)), (_BASE - 1 - F.col("packed") % _BASE).cast("int").alias("label"), F.floor(F.col("packed") / F.lit(_BASE).cast("decimal(20,0)")).cast("long").alias("n"))


def owned_cells(assigned: DataFrame, k: int) -> DataFrame:
    """(label, owned): cells in which a cluster is dominant, 0 included."""
    owned = dominant(cell_cluster_counts(assigned)).groupBy("label").agg(F.count(F.lit(1)).alias("owned"))
    return clusters(assigned, k).join(owned, "label", "left").select("label", F.coalesce("owned", F.lit(0)).cast("long").alias("owned"))


def cells_at_half(assigned: DataFrame, k: int, n_cells: int) -> DataFrame:
    """(label, cells50): how few cells hold half of a cluster; n_cells + 1 for an empty one.

    Cells of equal count are alike, so the running sum goes over a histogram (count, cells of that count), of which a
    cluster of N tokens has fewer than sqrt(2 N) rows, not over its cells.
    """
    histogram = cell_cluster_counts(assigned).groupBy("label", "n").agg(F.count(F.lit(1)).alias("cells"))
    size = F.col("n") * F.col("cells")
    above = Window.partitionBy("label").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    marked = histogram.select("label", "n", "cells", F.coalesce(F.sum(size).over(above), F.lit(0)).alias("before"), F.sum(size).over(Window.partitionBy("label")).alias("total"))
    left = F.col("total") - 2 * F.col("before")
    under = F.when(left > 0, F.least(F.col("cells"), F.floor((left - 1) / (2 * F.col("n"))))).otherwise(0)  # of these cells, those with less than half up to and with them
    half = marked.groupBy("label").agg((F.sum(under) + 1).alias("cells50"))
    return clusters(assigned, k).join(half, "label", "left").select("label", F.coalesce("cells50", F.lit(n_cells + 1)).cast("long").alias("cells50"))


def file_presence(assigned: DataFrame, k: int) -> DataFrame:
    """(label, files, share): files in which a cluster appears."""
    pairs = assigned.select("label", "file_id").distinct()
    total = assigned.agg(F.countDistinct("file_id").alias("total"))
    files = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("files"))
    out = clusters(assigned, k).join(files, "label", "left").join(F.broadcast(total))  # one row
    return out.select("label", F.coalesce("files", F.lit(0)).cast("long").alias("files"), (F.coalesce("files", F.lit(0)) / F.col("total")).alias("share"))


def bucket_counts(assigned: DataFrame, bucket: Column, name: str) -> DataFrame:
    """(bucket, label, n)."""
    return assigned.groupBy(bucket.alias(name), "label").agg(F.count(F.lit(1)).alias("n"))


def decile_counts(assigned: DataFrame, n_files: int) -> DataFrame:
    """(decile, label, n, decile_total)."""
    counts = bucket_counts(assigned, decile_of(F.col("file_id"), n_files), "decile")
    return counts.withColumn("decile_total", F.sum("n").over(Window.partitionBy("decile")))


def enrichment(counts: DataFrame, name: str, k: int) -> DataFrame:
    """(bucket, label, n, enrichment): a cluster's share of a bucket over its share of all.

    A cluster that is absent from a bucket with data has 0 there; buckets
    without data have no rows, so that plain averages skip them.
    """
    by_bucket = counts.groupBy(name).agg(F.sum("n").alias("in_bucket"))
    by_label = clusters(counts, k).join(counts.groupBy("label").agg(F.sum("n").alias("of_label")), "label", "left").na.fill(0, ["of_label"])
    total = counts.agg(F.sum("n").alias("total"))
    grid = by_bucket.crossJoin(F.broadcast(by_label)).crossJoin(F.broadcast(total))  # buckets x clusters: a grid of fixed size
    rows = grid.join(counts, [name, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    value = (F.col("n") / F.greatest("of_label", F.lit(1))) / F.greatest(F.col("in_bucket") / F.col("total"), F.lit(1e-12))
    return rows.select(name, "label", "n", value.alias("enrichment"))


def variation(enriched: DataFrame) -> DataFrame:
    """(label, cv): population deviation over mean of a cluster's enrichments."""
    return enriched.groupBy("label").agg((F.stddev_pop("enrichment") / F.greatest(F.avg("enrichment"), F.lit(1e-12))).alias("cv"))


def decile_profile(assigned: DataFrame, n_files: int, k: int, top: int = 8) -> DataFrame:
    """The clusters of most temporal variation, a column a decile; null where a decile has no data."""
    enriched = enrichment(bucket_counts(assigned, decile_of(F.col("file_id"), n_files), "decile"), "decile", k)
    best = variation(enriched).orderBy(F.desc(F.round("cv", 9)), "label").limit(top)
    wide = enriched.groupBy("label").pivot("decile", list(range(10))).agg(F.first("enrichment"))
    return wide.join(F.broadcast(best), "label").select("label", "cv", *[F.col(str(d)).alias(f"d{d}") for d in range(10)])


def purity(assigned: DataFrame) -> DataFrame:
    """(cells, purity): mean share of the dominant cluster of a cell."""
    per_cell = cell_cluster_counts(assigned).groupBy("cell_id").agg((F.max("n") / F.sum("n")).alias("p"))
    return per_cell.agg(F.count(F.lit(1)).alias("cells"), F.avg("p").alias("purity"))
