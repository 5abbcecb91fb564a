"""Reproducible samples: hash order instead of a random generator, so that any engine draws the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*parts: Column | int) -> Column:
    """A portable pseudo-random sort key."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def sample_files(files: DataFrame, n: int, seed: int) -> DataFrame:
    """n distinct files in hash order; rank is their load order."""
    key = hash_order(F.col("file_id"), seed)
    chosen = files.select("file_id").distinct().orderBy(key, "file_id").limit(n)
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(key, "file_id")))  # over the n rows of the sample


def reuse_files(tokens: DataFrame, listed: DataFrame) -> DataFrame:
    """Tokens of the files in a list."""
    return tokens.join(listed.select("file_id").distinct(), "file_id", "left_semi")


def sample_cells(tokens: DataFrame, per_file: int, seed: int) -> DataFrame:
    """``per_file`` tokens of each file, in hash order."""
    order = Window.partitionBy("file_id").orderBy(hash_order(F.col("file_id"), F.col("cell_id"), seed), "cell_id")
    return tokens.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= per_file).drop("draw")


def fingerprint(files: DataFrame, tokens_per_file: int, seed: int | None) -> DataFrame:
    """(fingerprint): 12 hex digits of the SHA-1 of tokens per file, seed and the sorted ids.

    Without a seed it names the content only, which is right where all cells are taken.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("file_id")), lambda f: f.cast("string")), ",")
    head = f"{tokens_per_file}|" + ("" if seed is None else f"{seed}|")
    return files.agg(F.substring(F.sha1(F.concat(F.lit(head), ids)), 1, 12).alias("fingerprint"))


def fingerprint_of(files: list[int], tokens_per_file: int | None, seed: int | None) -> str:
    """The same of a list on the driver; of whole files where tokens per file is None."""
    head = f"{'' if tokens_per_file is None else tokens_per_file}|" + ("" if seed is None else f"{seed}|")
    return hashlib.sha1((head + ",".join(map(str, sorted(set(files))))).encode()).hexdigest()[:12]


def estimate_bytes(tokens: DataFrame, dim: int, width: int = 2) -> DataFrame:
    """(n_tokens, bytes) that the features take at ``width`` bytes each."""
    return tokens.agg(F.count(F.lit(1)).alias("n_tokens"), (F.count(F.lit(1)) * dim * width).alias("bytes"))


def holdout_pool(files: DataFrame, trained: DataFrame, n: int, seed: int) -> DataFrame:
    """n files that weren't trained on, in hash order."""
    return sample_files(files.join(trained.select("file_id").distinct(), "file_id", "left_anti"), n, seed)
