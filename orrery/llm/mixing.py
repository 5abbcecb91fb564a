"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / w, u a hash of the row in (0, 1) and w its quality
weight; in ascending order the keys are a weighted sample without replacement.
Within a source, targets are met by whole epochs first, then by a prefix of
that order up to the rest of the word budget; the document at the edge gives
its first words only.

No source is ever sorted in one task: the key range of a source is cut into
buckets of about max(BUCKET_ROWS, sqrt(rows)) rows by the keys' distribution,
buckets are summed, and the sums' prefix sums show the bucket in which the
budget of a source runs out.  Documents of lower buckets give all their words,
those of higher ones none, so that bucket's documents are the only ones that
are sorted, and the only ones that are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.shared import settled, solid_words, whole_row

# Weights by the rank of a source, repeating; epochs at most.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BUCKET_ROWS = 256


def quality_weight(size: Column, chars: Column) -> Column:
    """1 for texts of ordinary word lengths, 0.5 for others and for texts under 20 words."""
    mean = chars / F.greatest(size, F.lit(1))
    return F.when((size >= 20) & (mean >= 3) & (mean <= 12), 1.0).otherwise(0.5)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target): total size shared by weight, capped at most_epochs times a source, excess reshared.

    The fixed point of resharing is target = min(cap, level * weight); the level
    is found from prefix sums over the sources in order of cap / weight.  One
    row per source passes through these windows, never one per document.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ladder = F.array(*[F.lit(float(w)) for w in weights])
    rows = by_source.withColumn("weight", F.get(ladder, F.pmod(rank, F.lit(len(weights))))).withColumn("cap", F.col("source_size") * float(most_epochs))
    everyone = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"total": F.sum("source_size").over(everyone), "all_weight": F.sum("weight").over(everyone), "capped": F.coalesce(F.sum("cap").over(rising), F.lit(0.0)), "capped_weight": F.coalesce(F.sum("weight").over(rising), F.lit(0.0))})
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight")))
    # The first source in that order whose cap isn't below its level ends the capped ones.
    level = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))).over(everyone)
    return rows.select("source", "source_size", "n_docs", F.least("cap", level * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS,
    bucket_rows: int = BUCKET_ROWS, carry: bool = False,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted).

    A null or wordless text has size 0 and gives nothing.  Rows without a
    source are a source of their own, ranked last.  Equal rows are ordered
    arbitrarily among themselves, which leaves the set of result rows as it is;
    reruns agree.  An empty table gives no rows.  Other columns are ignored.
    """
    body = F.col(f"`{text}`").cast("string")
    size = F.coalesce(F.size(solid_words(body)), F.lit(0)).cast("long")
    rows = docs.select(
        *([whole_row(docs)] if carry else []), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        size.alias("size"), F.coalesce(F.char_length(body), F.lit(0)).alias("chars"), F.xxhash64(F.col(f"`{doc_id}`"), body, F.lit(seed)).alias("tie"),
    )
    uniform = (F.shiftrightunsigned("tie", 11) + 0.5) / float(1 << 53)
    rows = settled(rows.withColumn("key", -F.log(uniform) / quality_weight(F.col("size"), F.col("chars"))).drop("chars"))
    goals = settled(source_targets(rows, weights, most_epochs))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    of_source = lambda table, more: table.alias("r").join(more.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).drop(F.col("g.source"))
    buckets = F.ceil(F.col("n_docs") / F.greatest(F.lit(float(bucket_rows)), F.sqrt("n_docs")))
    bucket = F.least(buckets - 1, F.floor(buckets * (1 - F.exp(F.col("key") * -0.9)))).cast("long")
    sums = of_source(rows.select("source", "size", "key"), goals.select("source", "n_docs", "rest")).groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The last bucket that the rest of the budget reaches; none if there is no rest.
    edges = sums.where("offset < rest").groupBy("source").agg(F.max(F.struct("bucket", "offset")).alias("edge"))
    edges = settled(goals.join(edges.select(F.col("source").alias("of"), "edge"), F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "n_docs", "target", "epochs", "rest", F.coalesce("edge.bucket", F.lit(-1)).alias("edge"), F.coalesce("edge.offset", F.lit(0)).alias("offset")))
    joined = of_source(rows, edges).withColumn("bucket", bucket)
    clear = joined.where("bucket <> edge").withColumn("part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0))
    within = Window.partitionBy("source").orderBy("key", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    cut = joined.where("bucket = edge").withColumn("part", F.least(F.greatest(F.col("rest") - ahead, F.lit(0)), F.col("size")))
    placed = clear.union(cut)
    return placed.select(*(["document"] if carry else []), "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))
