"""The corpus pipeline: toxicity, near copies, decontamination, personal data, mixing.

Each stage reads what the one before has written, as Parquet in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.decontaminate import decontaminate
from orrery.llm.jaccard import keep_one
from orrery.llm.mixing import mix_sources
from orrery.llm.pii import find_pii
from orrery.llm.shared import shared_folder
from orrery.llm.toxicity import score_toxicity


def _columns(docs: DataFrame, **new) -> list:
    """The columns of documents, from the carried row."""
    return [new.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject; null and empty texts stay, equal rows share a verdict."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return scored.where("predicted = 0").select(_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join; of equal rows one, null and empty texts and rows without id all stay."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none, equal rows share a verdict."""
    checked = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return checked.where("not contaminated").select(_columns(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text, null texts keep theirs."""
    masked = find_pii(docs, redact=True, carry=True)
    n_chars = F.coalesce(F.char_length("text").cast("long"), F.col("document.n_chars"))
    return masked.select(_columns(docs, text=F.col("text"), n_chars=n_chars))


#: What the mixing stage adds.
MIXED = ("size", "source_size", "target", "taken")


def _given(columns: list[str]) -> dict[str, str]:
    """The names under which the columns of documents leave the last stage: one that clashes with MIXED (in any case) gets ``_given`` behind it, as often as it takes."""
    taken, names = {c.lower() for c in MIXED}, {}
    others = {c.lower() for c in columns} - taken
    for c in columns:
        name = c
        while name.lower() in taken or (name != c and name.lower() in others):
            name += "_given"
        taken.add(name.lower())
        names[c] = name
    return names


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with size, source_size, target and taken: how many words the mixture takes of each.

    Null and empty texts have no words and give none; equal rows each get a row.  Columns of documents with one of
    these names are kept as size_given and so on.
    """
    mixed = mix_sources(docs, carry=True)
    return mixed.select(*[F.col("document").getField(c).alias(name) for c, name in _given(docs.columns).items()], *MIXED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix),
]

#: Learned scores can't be expressed in SQL; the test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
