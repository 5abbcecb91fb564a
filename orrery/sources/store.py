"""Reading and writing tokens, models, assignments, manifests and coastlines."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources import schema as S


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where none is named and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
    return context.getCheckpointDir().rstrip("/")


def _placed(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Is there such a file or folder, in whatever store the path names?"""
    files, place = _placed(spark, path)
    return files.exists(place)


def is_file(spark: SparkSession, path: str) -> bool:
    files, place = _placed(spark, path)
    return files.exists(place) and files.getFileStatus(place).isFile()


def read_tokens(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Tokens of exactly ``dim`` features; another length fails the read."""
    tokens = spark.read.schema(S.TOKENS).parquet(path)
    right = F.when(F.size("features") == dim, F.col("features")).otherwise(F.raise_error(F.lit(f"a token doesn't have {dim} features")))
    return tokens.withColumn("features", right)


def half_precision(tokens: DataFrame) -> DataFrame:
    """Features rounded to 16-bit floats, as a store of that width would hold them."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            column = batch.column("features")
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
            at = batch.schema.get_field_index("features")
            yield batch.set_column(at, "features", pa.ListArray.from_arrays(column.offsets, pa.array(values, pa.float32())))

    return tokens.mapInArrow(run, tokens.schema)


def save_model(model: DataFrame, run: DataFrame, history: DataFrame, path: str) -> None:
    """Model, run and history below one folder; shapes are checked first."""
    bad = model.where((F.size("eigvals") != F.size("basis")) | F.exists("basis", lambda b: F.size(b) != F.size(F.col("mean"))))
    if not bad.isEmpty():
        raise ValueError("a basis doesn't match its mean or its eigenvalues")
    for name, df, fields in (("clusters", model, S.MODEL), ("run", run, S.RUN), ("history", history, S.HISTORY)):
        df.select([F.col(f.name).cast(f.dataType) for f in fields]).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("clusters", S.MODEL), ("run", S.RUN), ("history", S.HISTORY)))


def save_assignments(assignments: DataFrame, path: str) -> None:
    assignments.select([F.col(f.name).cast(f.dataType) for f in S.ASSIGNMENTS]).write.mode("overwrite").parquet(path)


def load_assignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ASSIGNMENTS).parquet(path)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """One document as JSON, through Spark, so that any store it knows will do."""
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text, through Spark, so that any store it knows will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).removesuffix("\n")


def save_holdout(document: DataFrame, path: str) -> None:
    """The nested document of a hold-out evaluation, of one row, as JSON."""
    document.select([F.col(f.name).cast(f.dataType) for f in S.HOLDOUT]).coalesce(1).write.mode("overwrite").json(path)


def load_holdout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.HOLDOUT).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A sample manifest as one row."""
    return spark.read.schema(S.MANIFEST).json(path, multiLine=True)


def backfill_manifest(spark: SparkSession, run: DataFrame, path: str, tokens_per_file: int, seed: int, src: str) -> bool:
    """Writes the manifest of a run that has none yet; tells whether it did."""
    if exists(spark, path):
        return False
    row = run.select("fingerprint", "files").first()
    write_json(spark, {"fingerprint": row["fingerprint"], "num_files": len(row["files"]), "tokens_per_file": tokens_per_file, "seed": seed, "src": src, "files": row["files"]}, path)
    return True


def coastlines(spark: SparkSession, path: str) -> DataFrame:
    """(line, points): polylines of the LineString and MultiLineString features of a GeoJSON file."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", shape).alias("g")).select(F.explode("g.features.geometry").alias("g"))
    single, several = "array<array<double>>", "array<array<array<double>>>"
    lines = F.when(F.col("g.type") == "LineString", F.array(F.from_json("g.coordinates", single))).when(F.col("g.type") == "MultiLineString", F.from_json("g.coordinates", several))
    return rows.select(F.explode(lines).alias("points")).select(F.monotonically_increasing_id().alias("line"), "points")
