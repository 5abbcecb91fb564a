"""Quality rules as a short-circuit cascade of native expressions.

Every rule is a Boolean column over the row's measurements or its text, and
says what it touches: characters, words or nothing but numbers.  On a sample
drawn by hash these costs and each rule's rejections are summed in one
aggregate; rules are then tried in order of rejections per cost, in one CASE
that stops at the first rejection.  Neither depends on the machine, so the order,
and with it the rule that a document fails, is the same in every run; the
verdict doesn't depend on the order at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import solid_chars, solid_words, whole_row

WINDOW = 8
#: Rows, about, on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
#: Cost of one step, of matching a pattern at a character, and of an element of an array that a rule's lambda sees.
STEP, MATCH, ELEMENT = 1.0, 0.5, 2.0


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    cost: Column


def rules() -> list[Rule]:
    """The cascade's rules; a rule sees text and the columns of measure()."""
    n, chars = F.col("n_words"), F.char_length("text")
    marks = F.col("text").contains("!") | F.col("text").contains("?")
    return [
        Rule("symbols", F.col("n_symbols") * 100 > n * 10, F.lit(STEP)),
        Rule("shouting", F.when(marks, F.regexp_count("text", F.lit(r"[!?][!?]")) * 100 > n * 20).otherwise(F.lit(False)), F.when(marks, chars * MATCH).otherwise(F.lit(STEP))),
        Rule("stutter", F.size(F.filter("word_hash", lambda h, i: (i > 0) & (h == F.col("word_hash")[F.greatest(i - 1, F.lit(0))]))) * 100 > n * 30, n * ELEMENT),
        Rule("capitals", (chars - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) * 100 > F.col("word_chars") * 50, chars * MATCH),
        Rule("long_words", F.col("word_chars") > n * 15, F.lit(STEP)),
        Rule("duplicate_lines", F.col("n_dup_lines") * 100 > F.col("n_lines") * 40, F.lit(STEP)),
    ]


def measure(docs: DataFrame, doc_id: str, text: str, carry: bool) -> DataFrame:
    """Base measurements; each step is a projection of its own, so that no array is computed twice."""
    out = docs.select(*([whole_row(docs)] if carry else []), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("word_hash", F.transform(solid_words(F.col("text")), lambda w: F.xxhash64(w)))
    out = out.withColumn("n_words", F.size("word_hash").cast("long"))
    at = lambda i, j: F.get(F.col("word_hash"), i + j)
    out = out.withColumn(
        "windows",
        F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("word_hash") - WINDOW), lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")),
    )
    out = out.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    twin = lambda e, k: F.coalesce(F.get(F.col("sorted"), k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(F.col("sorted"), k + 1)["h"] == e["h"], F.lit(False))
    out = out.withColumn("repeated", F.sort_array(F.transform(F.filter("sorted", twin), lambda e: e["i"]))).drop("sorted", "windows")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("repeated", zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    out = out.withColumn("n_repeat_words", covered).drop("repeated")
    out = out.withColumn("lines", F.filter(F.split("text", "\n"), lambda s: solid_chars(s) != ""))
    return out.select(
        *(["document"] if carry else []), "doc_id", "text", "word_hash", "n_words",
        F.char_length(solid_chars(F.col("text"))).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)).alias("base_failed"),
    )


def rank_rules(docs: DataFrame, text: str, tried: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per cost on a sample, best first; never-rejecting rules last, cheapest first."""
    total = docs.count()
    body = F.col(f"`{text}`").cast("string")
    drawn = F.pmod(F.xxhash64(F.coalesce(body, F.lit("")), F.lit(29)), F.lit(1 << 30)) <= min(1.0, sample_rows / max(total, 1)) * (1 << 30)
    sample = measure(docs.where(drawn).select(F.lit(0).alias("doc_id"), body.alias("text")), "doc_id", "text", False)
    sums = [f(x) for rule in tried for f, x in ((F.count_if, rule.rejects), (lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)), rule.cost))]
    found = list(sample.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first())
    order = sorted(range(len(tried)), key=lambda i: (-(found[2 * i] / max(found[2 * i + 1], 1.0)), found[2 * i + 1], tried[i].name))
    return [tried[i] for i in order]


def judge_quality(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, carry: bool = False) -> DataFrame:
    """Per document: doc_id, the measurements, base_failed, failed_rule (null if kept), kept.

    A null text has no words and fails the base rule, as an empty one does.
    Reruns agree in every column.
    Texts under nine words have no repeated window.  Repeated rows each get a
    row; an empty table gives none.  Columns beside the named ones are ignored.
    """
    measured = measure(docs, doc_id, text, carry)
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rank_rules(docs, text, rules(), sample_rows):
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return measured.withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull()).drop("text", "word_hash")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
g AS (
  SELECT doc_id, text, words, len(words) AS n,
         CASE WHEN len(words) >= 8 THEN list_transform(range(1, len(words) - 6), lambda i: list_aggregate(words[i : i + 7], 'string_agg', ' ')) ELSE [] END AS wins,
         list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM w),
x AS (SELECT doc_id, unnest(wins) AS win, unnest(range(0, len(wins))) AS pos FROM g),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c FROM x),
h AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM r WHERE c > 1),
n AS (SELECT doc_id, sum(least(8, pos - coalesce(last, -8))) AS n_repeat_words FROM h GROUP BY doc_id),
m AS (
  SELECT doc_id, text, words, n, CAST(length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM g LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n < 20 OR 100 * n_repeat_words > 30 * n AS base_failed FROM m)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n
            OR 100 * len(regexp_extract_all(text, '[!?][!?]')) > 20 * n
            OR 100 * len(list_filter(range(2, n + 1), lambda i: words[i] = words[i - 1])) > 30 * n
            OR 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 50 * word_chars
            OR word_chars > 15 * n OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM b
"""
