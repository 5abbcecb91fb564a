"""The time axis: file numbers are six-hour steps from a start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, STEP_HOURS = "2014-01-01 00:00:00", 6


def timestamp_of(file_id: Column, start: str = START, step_hours: int = STEP_HOURS) -> Column:
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (file_id * step_hours).cast("int"))


def month_of(file_id: Column, start: str = START, step_hours: int = STEP_HOURS) -> Column:
    return F.month(timestamp_of(file_id, start, step_hours))


def decile_of(file_id: Column, n_files: int) -> Column:
    return F.floor(file_id.cast("long") * 10 / n_files).cast("int")


def time_axis(spark: SparkSession, n_files: int) -> DataFrame:
    """file_id, ts, month, decile."""
    file = F.col("id").cast("int")
    return spark.range(n_files).select(file.alias("file_id"), timestamp_of(file).alias("ts"), month_of(file).alias("month"), decile_of(file, n_files).alias("decile"))
