"""URL filter: explicit rules, then the ratio of two character language models.

URLs that a rule allows or blocks train one model each: n-gram counts of all
lengths up to ORDER over host and path, smoothed by Witten-Bell interpolation,
so that each position is judged in the longest context that its model has seen
and shorter ones fill in.  A URL's score is the mean difference of the two
models' log-likelihoods per character.  The threshold is calibrated on labelled
URLs that haven't trained the models that score them, one in HELD by hash: the
value with the best balanced accuracy in a histogram.  The models that judge
are trained on all of them.

All of it is DataFrame work.  The log-ratio of a position depends on its last
ORDER characters only, so it is computed once for each distinct n-gram of that
length, and positions are joined with that table; both grow with the input and
are shuffled by n-gram, but for the few n-grams that hold more than one
position in MOST_HOT (".com" is in nearly every URL): these are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import settled, whole_row

ORDER = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"
#: Scores are calibrated in steps of 1 / STEPS, between -LIMIT and LIMIT.
STEPS, LIMIT = 200, 20
#: One labelled URL in so many is held out to calibrate.
HELD = 5
#: An n-gram with more than one position in so many is hot, so there are fewer hot ones than this.
MOST_HOT = 1000


@dataclass(frozen=True)
class UrlRule:
    rule: str
    allow: bool

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


# The contract's rules.
RULES = (UrlRule("org/", True), UrlRule("example.org/es/", False), UrlRule("example.org/en/1", False), UrlRule("com/fr/", True), UrlRule("com/de/", False))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host, and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """The longest fitting rule and whether it allows; nulls if none fits."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, allow = F.when(fits, F.lit(rule.rule)).otherwise(name), F.when(fits, F.lit(rule.allow)).otherwise(allow)
    return name, allow


def _gram_positions(strings: DataFrame, order: int) -> DataFrame:
    """Each position's last ``order`` characters, markers included."""
    padded = F.concat(F.lit(_START * (order - 1)), F.col("body"), F.lit(_END))
    spread = strings.withColumn("padded", padded)
    return spread.select("*", F.explode(F.sequence(F.lit(1), F.char_length("body") + 1)).alias("at")).withColumn("gram", F.substring(F.col("padded"), F.col("at"), F.lit(order))).drop("padded", "at", "body")


def fit_ratio(labelled: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): log P_accepted - log P_rejected of the last character, for each wanted gram.

    ``labelled`` has gram, n_yes, n_no: counts of the full-length grams; those
    of the shorter ones are sums of them.
    """
    yes_no = [F.sum("n_yes").alias("n_yes"), F.sum("n_no").alias("n_no")]
    rows = wanted.select("gram", F.lit(1.0 / 256).alias("p_yes"), F.lit(1.0 / 256).alias("p_no"))
    for k in range(order):  # k characters of context
        suffix = F.substring(F.col("gram"), order - k, k + 1)
        grams = labelled.groupBy(suffix.alias("suffix")).agg(*yes_no)
        contexts = grams.groupBy(F.substring(F.col("suffix"), 1, k).alias("context")).agg(
            F.sum("n_yes").alias("c_yes"), F.sum("n_no").alias("c_no"), F.count_if(F.col("n_yes") > 0).alias("t_yes"), F.count_if(F.col("n_no") > 0).alias("t_no")
        )
        rows = rows.withColumn("suffix", suffix).withColumn("context", F.substring(F.col("gram"), order - k, k))
        rows = rows.join(grams, "suffix", "left").join(contexts, "context", "left").na.fill(0, ["n_yes", "n_no", "c_yes", "c_no", "t_yes", "t_no"])
        smooth = lambda side: F.when(F.col(f"c_{side}") > 0, (F.col(f"n_{side}") + F.col(f"t_{side}") * F.col(f"p_{side}")) / (F.col(f"c_{side}") + F.col(f"t_{side}"))).otherwise(F.col(f"p_{side}"))
        rows = rows.select("gram", smooth("yes").alias("p_yes"), smooth("no").alias("p_no"))
    return rows.select("gram", (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def with_ratios(positions: DataFrame, counts: DataFrame, ratios: DataFrame) -> DataFrame:
    """The positions with their ratio; ``counts`` has gram and places, the number of positions it was counted over."""
    total = counts.agg(F.sum("places")).first()[0] or 0
    hot = settled(ratios.join(counts.where(F.col("places") * MOST_HOT > total).select("gram"), "gram"), small=True)
    marked = positions.join(F.broadcast(hot), "gram", "left")  # bounded: fewer than MOST_HOT rows
    return marked.where("ratio is not null").unionByName(marked.where("ratio is null").drop("ratio").join(ratios, "gram"))


def calibrate(scored: DataFrame) -> float:
    """The score with the best balanced accuracy on labelled rows (allow, score); one row a step is gathered."""
    step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-LIMIT)), F.lit(LIMIT)) * STEPS)
    counts = scored.groupBy(step.alias("step")).agg(F.count_if("allow").alias("yes"), F.count_if(~F.col("allow")).alias("no")).collect()
    yes, no = sum(r["yes"] for r in counts), sum(r["no"] for r in counts)
    if not yes or not no:
        return float(-LIMIT) if yes or not no else float(LIMIT)
    best, threshold, below_yes, below_no, before = -1.0, 0.0, 0, 0, None
    for r in sorted(counts, key=lambda r: r["step"]):
        accuracy = (yes - below_yes) / yes + below_no / no
        if accuracy > best:  # half-way from the scores below, so that what lies between goes to the nearer side
            best, threshold = accuracy, (r["step"] if before is None else (before + r["step"]) / 2) / STEPS
        below_yes, below_no, before = below_yes + r["yes"], below_no + r["no"], r["step"]
    return float(threshold)


def held_out_threshold(positions: DataFrame, order: int) -> float | None:
    """The threshold on one labelled URL in HELD, scored by models of the others; None if either part lacks a class."""
    known = positions.where(F.col("allow").isNotNull()).withColumn("held", F.pmod(F.xxhash64("key", F.lit(31)), F.lit(HELD)) == 0)
    parts = {(r["held"], r["allow"]) for r in known.select("held", "allow").distinct().collect()}  # four rows
    if len(parts) < 4:
        return None
    counts = known.groupBy("gram").agg(*[F.sum(F.when(~F.col("held") & (F.col("allow") == allow), F.col("n")).otherwise(0)).alias(name) for allow, name in ((True, "n_yes"), (False, "n_no"))], F.count(F.lit(1)).alias("places"))
    counts = settled(counts)
    ratios = settled(fit_ratio(counts.where("n_yes + n_no > 0"), counts, order))
    return calibrate(with_ratios(known.where("held"), counts, ratios).groupBy("key").agg(F.round(F.avg("ratio"), 6).alias("score"), F.first("allow").alias("allow")))


def judge_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES, order: int = ORDER, carry: bool = False) -> DataFrame:
    """Per page: page_id, host, path, rule, score (null where a rule decides), verdict.

    Null URLs and those without ``://`` have an empty host and path and are
    scored like any string.  If no rule accepts or none rejects anything,
    there is nothing to compare and undecided URLs go with the class there is
    (allow if there is none).  Repeated rows each get a row; an empty table
    gives none.  Columns beside the named ones are ignored.
    """
    host, path = url_parts(F.col(f"`{url}`").cast("string"))
    rows = pages.select(*([whole_row(pages)] if carry else []), F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    name, allow = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "allow": allow}).withColumn("body", F.concat("host", "path")).withColumn("key", F.xxhash64("host", "path"))
    bodies = rows.groupBy("key").agg(F.first("body").alias("body"), F.first("allow").alias("allow"), F.count(F.lit(1)).alias("n"))
    positions = settled(_gram_positions(bodies, order))
    counted = positions.groupBy("gram").agg(F.sum(F.when(F.col("allow"), F.col("n")).otherwise(0)).alias("n_yes"), F.sum(F.when(~F.col("allow"), F.col("n")).otherwise(0)).alias("n_no"), F.count(F.lit(1)).alias("places"))
    counted = settled(counted)
    ratios = settled(fit_ratio(counted.where("n_yes + n_no > 0"), counted, order))
    scores = with_ratios(positions, counted, ratios).groupBy("key").agg(F.round(F.avg("ratio"), 6).alias("score"), F.first("allow").alias("allow"))
    scores = settled(scores)
    threshold = held_out_threshold(positions, order)
    if threshold is None:  # too few labelled URLs to hold any out
        threshold = calibrate(scores.where(F.col("allow").isNotNull()))
    judged = rows.drop("body").join(scores.select("key", "score"), "key", "left")
    allowed = F.coalesce("allow", F.col("score") >= threshold)
    return judged.select(
        *(["document"] if carry else []), "page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), F.col("score")).alias("score"), F.when(allowed, "allow").otherwise("block").alias("verdict")
    )
