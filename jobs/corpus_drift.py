"""Reports how the make-up of a text collection shifts along its ids, as the clusters of a vector collection do along time.

    python -m jobs.corpus_drift --documents FOLDER --out FOLDER [--config FILE]

Whole texts become vectors (shares of the letters a-z).  The documents of each class (the ``max_classes`` most
frequent values of the class column, ties by name) give a centroid; every document is assigned to the nearest.  Written
are ``out/assignments/bucket=...`` (a tenth of the range of ids each) and, from what was written, ``out/drift``: per
bucket and cluster the enrichment, its variation over the buckets, and how well clusters and classes agree.  Each run
replaces both whole, so a rerun gives the same files.  Documents without id keep their assignment but belong to no
bucket and so to no row of the drift; null and empty texts are a vector of zeros.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, main
from orrery.functions.text import letter_counts, shares
from orrery.operators import compare, spatial, vectors

NAME = "corpus_drift"
LOG = logging.getLogger(NAME)

ASSIGNED = "doc_id long, class string, cluster int, residual double, bucket int"
DRIFT = "bucket int, label int, class string, n long, enrichment double, cv double, nmi double, ari double, purity double"


def classes(docs: DataFrame, most: int) -> DataFrame:
    """(cluster, class): the most frequent classes, numbered by name; at most ``most`` rows."""
    chosen = docs.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class").limit(most)
    names = chosen.agg(F.sort_array(F.collect_list("class")).alias("names"))
    return names.select(F.posexplode("names").alias("cluster", "class"))


def purity(rows: DataFrame) -> DataFrame:
    """(purity): the mean share of the most frequent class of a cluster."""
    counts = rows.where("class is not null").groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cluster").agg((F.max("n") / F.sum("n")).alias("p")).agg(F.avg("p").alias("purity"))


def run(spark: SparkSession, documents: str, out: str, settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Assignments and drift, as written."""
    settings = config(NAME) | (settings or {})
    raw = spark.read.parquet(documents)
    docs = raw.select(F.col(settings["id"]).cast("long").alias("doc_id"), F.col(settings["class"]).cast("string").alias("class"), F.col(settings["text"]).alias("text"))
    seen = Observation(NAME)
    counted = docs.select("doc_id", "class", letter_counts(F.col("text")).alias("counts")).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("no_id"))
    counted.write.mode("overwrite").parquet(f"{out}/vectors")  # texts are read once; centroids and distances read this
    LOG.info("read %d documents of %s, %d without id", seen.get["rows"], documents, seen.get["no_id"])

    features = spark.read.parquet(f"{out}/vectors").select("doc_id", "class", shares(F.col("counts")).alias("features"))
    known = classes(features, settings["max_classes"])
    model = vectors.centroids(features.join(F.broadcast(known), "class").select(F.col("cluster").alias("label"), "features"))
    ends = features.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    placed = vectors.assign_in_row(features, model).crossJoin(F.broadcast(ends))  # one row
    span = F.col("most") - F.col("least") + 1
    bucket = F.floor((F.col("doc_id") - F.col("least")) * settings["buckets"] / span).cast("int")
    rows = placed.select("doc_id", "class", "cluster", "residual", bucket.alias("bucket"))
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/assignments")

    done = spark.read.schema(ASSIGNED).parquet(f"{out}/assignments")
    names = known.select(F.col("cluster").alias("label"), "class")
    k = known.count()
    inside = done.where("bucket is not null and cluster is not null")
    enriched = spatial.enrichment(inside.groupBy("bucket", F.col("cluster").alias("label")).agg(F.count(F.lit(1)).alias("n")), "bucket", k)
    both = done.where("class is not null and cluster is not null")
    agreement = compare.nmi(both, "cluster", "class").crossJoin(compare.ari(both, "cluster", "class")).crossJoin(purity(both))  # one row each
    drift = enriched.join(spatial.variation(enriched), "label").join(F.broadcast(names), "label").crossJoin(F.broadcast(agreement))
    drift.select(*[c.split()[0] for c in DRIFT.split(", ")]).coalesce(1).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/drift")  # buckets x classes rows
    written = spark.read.schema(DRIFT).parquet(f"{out}/drift")
    LOG.info("wrote %d assignments and %d rows of drift below %s", done.count(), written.count(), out)
    return done, written


if __name__ == "__main__":
    main(NAME, __doc__, {"documents": "Parquet file or folder of documents", "out": "folder of assignments and drift"}, run)
