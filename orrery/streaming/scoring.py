"""Scoring a stream of tokens with a frozen model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.subspaces import Model, assigned
from orrery.sources.schema import TOKENS


def read_token_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(tokens: DataFrame, model: Model, out: str, checkpoint: str) -> StreamingQuery:
    """Appends file_id, cell_id, label, residual as Parquet; assignment keeps no state, so a restart resumes from the checkpoint."""
    scored = assigned(tokens, model).select("file_id", "cell_id", "label", "residual")
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
