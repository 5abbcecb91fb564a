"""What the operators share: whole rows carried along, and results kept where every executor sees them."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word patterns of the contracts, as Java regular expressions.
SOLID_WORD = r"[^\x20\x09-\x0D]+"
#: As for lower-cased text, with A-Z added, so that the text needn't be lower-cased.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


_UPPER, _LOWER, _BLANKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "\t\n\x0b\x0c\r"
_BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != " ")


def solid_words(text: Column) -> Column:
    """The matches of SOLID_WORD, by mapping characters and splitting at spaces: several times faster than the pattern."""
    return F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")


def alnum_words(text: Column) -> Column:
    """The matches of ALNUM_WORD, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, _UPPER + _BREAKS, _LOWER + " " * len(_BREAKS)), " "), "")


def solid_chars(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, _BLANKS + " ", "")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is named and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
    return context.getCheckpointDir().rstrip("/")


def settled(df: DataFrame, small: bool = False) -> DataFrame:
    """The same rows, written as Parquet to the shared folder: lineage is cut, a lost executor takes nothing.

    ``small`` tables (narrow, for a part of the input) are written by a sixteenth of the tasks.
    """
    if small:
        df = df.coalesce(max(8, parallel(df.sparkSession) // 16))
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more; what a result still reads stays until the folder is emptied."""
    for df in tables:
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no new name can clash with one of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("document")


def free_name(name: str, columns: list[str]) -> str:
    """A name that none of the columns has, in any case: the given one with as many underscores as it takes."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parallel(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Bounds the session's Arrow batches by bytes: long texts would make batches of 10,000 rows large in JVM and Python at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > limit:
        spark.conf.set(key, str(limit))
