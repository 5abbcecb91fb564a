"""One call from a token table to the tokens of a reproducible sample of its files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators import sampling
from orrery.sources import store
from orrery.sources.schema import TOKENS, LoadConfig

#: Folder of the table that holds consecutive files.
FOLDER = "folder"
TABLE = T.StructType([*TOKENS.fields, T.StructField(FOLDER, T.IntegerType())])


@dataclass(frozen=True)
class Loaded:
    """tokens: file_id, cell_id, features, rank (of the file, in load order) and fingerprint; files in load order."""

    tokens: DataFrame
    files: list[int]
    fingerprint: str


def write_token_table(tokens: DataFrame, path: str, files_per_folder: int = 1) -> None:
    """A token table in folders of consecutive files, sorted by file and cell, so that a sample reads its own files only.

    A file of full size (12,288 tokens of 2,048 floats) is 100 MB, a folder of its own; take more for small ones.
    """
    rows = tokens.select("file_id", "cell_id", F.col("features").cast("array<float>").alias("features"), F.floor(F.col("file_id") / files_per_folder).cast("int").alias(FOLDER))
    dealt = rows.repartitionByRange(FOLDER, "file_id", "cell_id").sortWithinPartitions(FOLDER, "file_id", "cell_id")
    dealt.write.mode("overwrite").partitionBy(FOLDER).parquet(path)


def folders_of(spark: SparkSession, path: str) -> DataFrame:
    """The table's file_id column alone, for lists of files."""
    return spark.read.schema(TABLE).parquet(path).select("file_id")


def _chosen(spark: SparkSession, path: str, cfg: LoadConfig) -> list[int]:
    """Ids of the sampled files, in load order: what the manifest lists anyway."""
    if cfg.files_from is not None:
        return list(store.manifest(spark, cfg.files_from).first()["files"])
    files = spark.range(cfg.n_files_total).select(F.col("id").cast("int").alias("file_id")) if cfg.n_files_total is not None else folders_of(spark, path)
    return [r["file_id"] for r in sampling.sample_files(files, cfg.num_files, cfg.seed).orderBy("rank").collect()]


def load_tokens(spark: SparkSession, path: str, cfg: LoadConfig, out: str | None = None) -> Loaded:
    """Samples files (or takes a manifest's), writes the manifest to ``out``, and gives the tokens, checked as they are read.

    Only the folders of sampled files are scanned.  A token of another dimension or a cell outside the files' cells
    fails the read; a file that is listed but missing, or that hasn't exactly ``n_cells`` tokens where those are given, fails the
    call, as does a sample of more than ``max_bytes`` half-precision bytes.  Under ``tokens_per_file`` each file gives
    so many tokens, in hash order.
    """
    files = _chosen(spark, path, cfg)
    per_file = cfg.tokens_per_file if cfg.n_cells is None or cfg.tokens_per_file is None else min(cfg.tokens_per_file, cfg.n_cells)
    named = sampling.fingerprint_of(files, per_file, cfg.seed)
    if out is not None:
        store.write_json(spark, {"fingerprint": named, "num_files": len(files), "tokens_per_file": per_file, "seed": cfg.seed, "src": path, "files": files}, f"{out}/sample.json")
    if cfg.max_bytes is not None and per_file is not None and len(files) * per_file * cfg.dim * 2 > cfg.max_bytes:
        raise MemoryError(f"{len(files)} files of {per_file} tokens would take {len(files) * per_file * cfg.dim * 2} bytes, over {cfg.max_bytes}")
    listed = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file_id int, rank int")
    table = spark.read.schema(TABLE).parquet(path)
    scan = table.where(F.col(FOLDER).isin(sorted({f // cfg.files_per_folder for f in files})))
    if cfg.files_per_folder > 1 and files:
        scan = scan.where(F.col("file_id").between(min(files), max(files)))
    _check_files(scan, listed, cfg.n_cells)
    rows = scan.join(F.broadcast(listed), "file_id")  # one small row for each file of the manifest
    fine = (F.size("features") == cfg.dim) & ~F.exists("features", lambda x: x.isNull())
    inside = F.col("cell_id") >= 0 if cfg.n_cells is None else F.col("cell_id").between(0, cfg.n_cells - 1)
    said = F.concat(F.lit("file "), F.col("file_id"), F.lit(f" has a token without {cfg.dim} features or with a cell of another grid: cell "), F.coalesce(F.col("cell_id").cast("string"), F.lit("null")))
    checked = F.when(F.coalesce(fine & inside, F.lit(False)), F.col("features")).otherwise(F.raise_error(said))
    rows = rows.select("file_id", "cell_id", checked.alias("features"), "rank")
    if per_file is not None and (cfg.n_cells is None or per_file < cfg.n_cells):
        rows = sampling.sample_cells(rows, per_file, cfg.seed)
    return Loaded(rows.withColumn("fingerprint", F.lit(named)), files, named)


def _check_files(scan: DataFrame, listed: DataFrame, n_cells: int | None) -> None:
    """Reads two narrow columns of the sampled files; one row a file, of which only bad ones come to the driver."""
    found = scan.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("cells"))
    n, cells = F.coalesce("n", F.lit(0)), F.coalesce("cells", F.lit(0))
    bad = (n == 0) | (n != cells) if n_cells is None else (n != n_cells) | (cells != n_cells)
    wrong = listed.join(found, "file_id", "left").where(bad).orderBy("rank").select("file_id", n.alias("n"), cells.alias("cells")).first()
    if wrong is not None:
        raise ValueError(f"file {wrong['file_id']} has {wrong['n']} tokens of {wrong['cells']} cells" + (f", not {n_cells}" if n_cells is not None else ""))
