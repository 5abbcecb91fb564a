"""Assigns the tokens of newly arrived files to a frozen model and keeps the monthly cube of assignments.

    python -m jobs.score_new_files --tokens FOLDER --out FOLDER [--config FILE]

The first run freezes the centroids of the labelled tokens it finds as ``out/model``; later runs only read them (put a
model of your own there to use that).  A file stream with a checkpoint takes each token file once.  Every
micro-batch writes its assignments to ``out/assignments/batch=.../month=...`` and then, for the months it has touched,
counts them anew into ``out/cube/month=...`` and takes each cell's dominant cluster into ``out/dominant/month=...``.  All
overwrite whole partitions only, so a batch that is taken up again after a failure gives the same files.  At the
end, ``out/flips`` says how many cells change their dominant cluster from month to month.  Tokens without a usable
vector or id are counted in the log and left out.  Checkpoint and output belong together: to begin anew, take a new folder.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, main
from orrery.functions.calendar import month_of
from orrery.operators import subspaces, temporal, vectors
from orrery.sources.schema import MODEL

NAME = "score_new_files"
LOG = logging.getLogger(NAME)

ASSIGNED = "file_id int, cell_id int, label int, residual double, batch long, month int"
CUBE = "cell_id int, label int, n long, residual double, month int"
DOMINANT = "cell_id int, label int, n long, month int"
FLIPS = "month int, both long, flips long, rate double"


def usable(settings: dict, width: int | None = None) -> Column:
    """Has the row an id that can be placed and a vector of finite numbers, of ``width`` if that is known?"""
    vector, number = F.col(settings["vector"]), F.col(settings["id"])
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    right = F.size(vector) > 0 if width is None else F.size(vector) == width
    return F.coalesce(number.isNotNull() & (number >= 0) & vector.isNotNull() & right & fine, F.lit(False))


def as_tokens(rows: DataFrame, settings: dict) -> DataFrame:
    """file_id, cell_id, label, features: the id counts cells through all files."""
    number, cells = F.col(settings["id"]), settings["cells_per_file"]
    return rows.select(F.floor(number / cells).cast("int").alias("file_id"), (number % cells).cast("int").alias("cell_id"), F.col(settings["label"]).alias("label"), F.col(settings["vector"]).cast("array<double>").alias("features"))


def saved_model(spark: SparkSession, out: str) -> DataFrame | None:
    """The rows of the model below ``out``, if a whole one is there."""
    try:
        rows = spark.read.schema(MODEL).parquet(f"{out}/model/clusters")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if rows.isEmpty() else rows  # nothing is visible of a write that didn't end


def frozen_model(spark: SparkSession, tokens: str, out: str, settings: dict) -> subspaces.Model:
    """The model below ``out``; where there is none yet, the centroids of the labelled tokens become it."""
    rows = saved_model(spark, out)
    if rows is None:
        labelled = as_tokens(spark.read.parquet(tokens).where(usable(settings)), settings).where("label is not null")
        if labelled.isEmpty():
            raise ValueError(f"there are no labelled tokens in {tokens} and no model below {out}")
        found = vectors.centroids(labelled)
        none = F.array()
        found = found.select("cluster", "mean", none.cast("array<array<double>>").alias("basis"), none.cast("array<double>").alias("eigvals"), F.lit(0.0).alias("trace"), "n", F.lit(0.0).alias("evr"), F.lit(None).cast("double").alias("radius"), F.lit(False).alias("reseeded"))
        found.coalesce(1).write.mode("overwrite").parquet(f"{out}/model/clusters")  # one row a cluster
        LOG.info("froze the centroids of the labelled tokens of %s below %s", tokens, out)
        rows = saved_model(spark, out)
    return subspaces.model_from(rows)


def take_batch(rows: DataFrame, batch: int, model: subspaces.Model, clusters: list[int], out: str, settings: dict) -> None:
    """Writes the assignments of one micro-batch and the cube of the months it touches."""
    spark, seen = rows.sparkSession, Observation(f"{NAME}-{batch}")
    good = usable(settings, model.means.shape[1])
    kept = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~good).alias("left_out")).where(good)
    scored = subspaces.assigned(as_tokens(kept, settings), model).select("file_id", "cell_id", F.element_at(F.array(*map(F.lit, clusters)), F.col("label") + 1).alias("label"), F.greatest("residual", F.lit(0.0)).alias("residual"))
    scored = scored.withColumns({"batch": F.lit(batch).cast("long"), "month": month_of(F.col("file_id"))}).hint("rebalance", "month")
    dynamic = {"partitionOverwriteMode": "dynamic"}
    scored.write.mode("overwrite").options(**dynamic).partitionBy("batch", "month").parquet(f"{out}/assignments")
    LOG.info("batch %d: read %d rows, left out %d without usable vector or id", batch, seen.get["rows"], seen.get["left_out"])
    if seen.get["rows"] == seen.get["left_out"]:
        return
    every = spark.read.schema(ASSIGNED).parquet(f"{out}/assignments")
    months = [r["month"] for r in every.where(F.col("batch") == batch).select("month").distinct().collect()]  # twelve at most
    touched = every.where(F.col("month").isin(months))
    cube = temporal.cube(touched, F.sum("residual").alias("residual")).select("cell_id", "label", "n", "residual", "month")
    cube.write.mode("overwrite").options(**dynamic).partitionBy("month").parquet(f"{out}/cube")
    counted = spark.read.schema(CUBE).parquet(f"{out}/cube").where(F.col("month").isin(months))
    best = temporal.monthly_dominant(counted).select("cell_id", "label", "n", "month")
    best.coalesce(1).write.mode("overwrite").options(**dynamic).partitionBy("month").parquet(f"{out}/dominant")  # a row a cell
    LOG.info("batch %d: wrote its assignments, and cube and dominant clusters of months %s below %s", batch, sorted(months), out)


def read_back(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """assignments, cube, dominant and flips as they stand; empty where nothing has come yet."""
    tables = {}
    for name, schema in (("assignments", ASSIGNED), ("cube", CUBE), ("dominant", DOMINANT), ("flips", FLIPS)):
        try:
            tables[name] = spark.read.schema(schema).parquet(f"{out}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            tables[name] = spark.createDataFrame([], schema)
    return tables


def run(spark: SparkSession, tokens: str, out: str, settings: dict | None = None) -> dict[str, DataFrame]:
    """Takes what is new below ``tokens``; returns the tables of ``read_back`` as they stand afterwards."""
    settings = config(NAME) | (settings or {})
    model = frozen_model(spark, tokens, out, settings)
    clusters = [r["cluster"] for r in saved_model(spark, out).select("cluster").orderBy("cluster").collect()]
    shape = spark.read.parquet(tokens).schema
    listed = f"{tokens[:-1]}[{tokens[-1]}]" if not tokens.endswith("/") else tokens  # a pattern, as a file stream takes single files by pattern only
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(listed)
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: take_batch(rows, batch, model, clusters, out, settings))
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    taken = sum(p["numInputRows"] > 0 for p in query.recentProgress)
    LOG.info("%s: %d batches with new files", tokens, taken)
    flips = temporal.flip_rates(read_back(spark, out)["cube"])
    flips.coalesce(1).write.mode("overwrite").parquet(f"{out}/flips")  # eleven rows, from the cube: the same again if nothing is new
    return read_back(spark, out)


if __name__ == "__main__":
    main(NAME, __doc__, {"tokens": "folder of Parquet token files", "out": "folder of model, checkpoint and output"}, run)
