"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import codes, lines, quality
from orrery.llm.decontaminate import decontaminate
from orrery.llm.jaccard import jaccard_components
from orrery.llm.licenses import DECLARATIONS, TEMPLATES, scan_licenses
from orrery.llm.mixing import mix_sources
from orrery.llm.pii import BASE, find_pii, span_string
from orrery.llm.quotes import link_quotations
from orrery.llm.repeats import remove_repeats
from orrery.llm.toxicity import score_toxicity
from orrery.llm.urls import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(_table(spark, sf_dir, "conversations")).withColumn("reply_key", F.array_join(F.col("reply_key").cast("array<string>"), ":"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.sha2(span_string(F.filter(spans, lambda s: s["base"])), 256)
    return find_pii(_table(spark, sf_dir, "documents")).select("doc_id", *counts, base.alias("base_sha256"), span_string(spans).alias("spans"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"), templates={**TEMPLATES, **DECLARATIONS}, across_lines=True, gram=2)
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge_quality(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_shared_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_repeats": op7_repeats,
    "op8_mixing": op8_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
}

ORACLES: dict[str, str] = {
    "op10_quality_rules": quality.ORACLE,
    "op11_line_dedup": lines.ORACLE,
    "op12_vector_codes": codes.oracle(),
}
