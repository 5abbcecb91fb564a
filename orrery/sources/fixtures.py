"""Assignments and tokens made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLUSTERS, CELLS, NSIDE = 8, 192, 4
TOKEN_CELLS, TOKEN_CLUSTERS, TOKEN_DIM = 48, 10, 64


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, cell_id, label and a second labelling, other."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cell = F.col("l_partkey") % CELLS
    return line.select(
        (4 * F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) + F.col("l_linenumber") % 4).cast("int").alias("file_id"),
        cell.cast("int").alias("cell_id"),
        ((F.floor(cell / 24) + F.col("l_suppkey") % 3) % CLUSTERS).cast("int").alias("label"),
        ((F.floor(cell / 32) + F.col("l_suppkey") % 2) % 6).cast("int").alias("other"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_id, file_id, cell_id, label, features (doubles)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(
        F.col("vec_id").alias("token_id"), F.floor(F.col("vec_id") / TOKEN_CELLS).cast("int").alias("file_id"), (F.col("vec_id") % TOKEN_CELLS).cast("int").alias("cell_id"),
        "label", F.col("embedding").cast("array<double>").alias("features"),
    )


ASSIGN_SQL = """assign AS (
  SELECT CAST(4 * date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + l_linenumber % 4 AS INTEGER) AS file_id,
         CAST(l_partkey % 192 AS INTEGER) AS cell_id,
         CAST(((l_partkey % 192) // 24 + l_suppkey % 3) % 8 AS INTEGER) AS label,
         CAST(((l_partkey % 192) // 32 + l_suppkey % 2) % 6 AS INTEGER) AS other
  FROM lineitem)"""

TOKENS_SQL = """tokens AS (
  SELECT vec_id AS token_id, CAST(vec_id // 48 AS INTEGER) AS file_id, CAST(vec_id % 48 AS INTEGER) AS cell_id, label, CAST(embedding AS DOUBLE[]) AS features
  FROM embeddings),
long AS (SELECT token_id, file_id, cell_id, label, CAST(d AS INTEGER) AS dim, features[d + 1] AS v FROM tokens, (SELECT unnest(range(0, 64)) AS d)),
means AS (SELECT label AS cluster, dim, avg(v) AS m, count(*) AS n FROM long GROUP BY label, dim)"""
