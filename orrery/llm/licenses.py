"""License scans: exact phrases, and an exact set-similarity join of text blocks with license notices.

A template is a notice.  Texts and notices are sequences of word n-grams (words
themselves for n = 1).  A block is a window of consecutive n-grams, WINDOW times
as many as the notice has, of a document (line breaks don't count) or, where
lines are asked for, of one of its lines; both are sets of n-grams.  A block
meets a template if it holds at least CONTAINMENT of the template's n-grams,
whatever else it holds; pairs of words already tell a notice from prose that
happens to use its words.  Template n-grams are ordered by how many documents
hold them, rarest first; a block that meets a template of n, of which it needs
m, must hold one of the n - m + 1 rarest (prefix filter), and after the first
shared one, at place p of the template, can share n - p at most (positional
filter).  So only the windows around prefix n-grams are looked at: all windows
that hold one, after what stands around it has been found to be enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import alnum_words, settled, whole_row

# Phrases and labels of the contract, in its order.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices, from public license texts.  The table is part of the code, so its size is bounded.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under a creative commons attribution share alike license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "apache-header": "you may not use this file except in compliance with the license",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit": "released under the mit license",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this work is released into the public domain",
}
#: One-line declarations; as sets of words they would be found in any prose, so they are for n-grams of two words or more.
DECLARATIONS = {
    "gpl-2-line": "gpl v2 or later",
    "gpl-3-line": "gpl v3 or later",
    "license-apache": "license apache 2 0",
    "license-mit": "license mit",
    "spdx-apache-2.0": "spdx license identifier apache 2 0",
    "spdx-bsd-3-clause": "spdx license identifier bsd 3 clause",
    "spdx-gpl-2.0": "spdx license identifier gpl 2 0",
    "spdx-gpl-3.0": "spdx license identifier gpl 3 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-mpl-2.0": "spdx license identifier mpl 2 0",
}
CONTAINMENT = 0.8
#: A notice is met within so many times its own number of words.
WINDOW = 2


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _places(phrase: str) -> Column:
    """Starts of a phrase in the column ``words``; texts without its first word aren't searched."""
    parts = phrase.split()

    def same(i: Column) -> Column:
        out = F.get(F.col("words"), i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            out = out & (F.get(F.col("words"), i + j) == part)
        return F.coalesce(out, F.lit(False))

    return F.when(F.array_contains("words", parts[0]), F.filter(F.sequence(F.lit(0), F.size("words")), same)).otherwise(F.array().cast("array<int>"))


def word_grams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, in their order; fewer words have none."""
    # By zipping, as a lambda that looks into the array would make Spark split the text anew for every word.
    out = words
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, k + 1, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(out) if n > 1 else out


def notice_grams(notice: str, n: int) -> list[str]:
    """The n-grams of a notice, in its order."""
    words = notice.split()
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def template_prefixes(scanned: DataFrame, templates: dict[str, str], containment: float, gram: int) -> DataFrame:
    """label, token, place, need, size, tokens, window: the prefix of each template in the order of document frequencies."""
    seen = scanned.select(F.explode("vocabulary").alias("token"))
    counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a template token at most
    rows = []
    for label, notice in templates.items():
        tokens = sorted(set(notice_grams(notice, gram)), key=lambda w: (counts.get(w, 0), w))
        need = -(-len(tokens) * round(containment * 100) // 100)
        rows += [(label, w, place, need, len(tokens), tokens, WINDOW * len(notice_grams(notice, gram))) for place, w in enumerate(tokens[: len(tokens) - need + 1])]
    return scanned.sparkSession.createDataFrame(rows, "label string, token string, place int, need int, size int, tokens array<string>, window int")


def match_templates(docs: DataFrame, text: str, prefixes: DataFrame, across_lines: bool, gram: int) -> DataFrame:
    """(text_key, label, share) of the texts that hold a block meeting a template."""
    known = prefixes.select("token", "window").collect()  # a few tokens a template
    tokens, reach = sorted({r["token"] for r in known}), max((r["window"] for r in known), default=1) - 1
    # Texts and lines without any prefix token are dropped before places are looked for.
    body = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    parts = body.select(F.md5("text").alias("text_key"), F.col("text").alias("part") if across_lines else F.explode(F.split("text", "\n")).alias("part"))
    keyed = parts.select("text_key", alnum_words(F.col("part")).alias("words"))
    keyed = keyed.select("text_key", word_grams(F.col("words"), gram).alias("grams")).where(F.arrays_overlap("grams", _strings(tokens)))
    # Each prefix token with the tokens around it, as far as the longest window can reach.
    least = lambda i: F.greatest(i - reach, F.lit(0))
    places = F.filter(F.transform("grams", lambda w, i: F.when(w.isin(tokens), i)), lambda i: i.isNotNull())
    keyed = keyed.select("text_key", F.explode(F.transform(places, lambda i: F.struct(F.get("grams", i).alias("token"), (i - least(i)).alias("at"), F.slice("grams", least(i) + 1, F.lit(2 * reach + 1)).alias("near")))).alias("hit"))
    pairs = keyed.select("text_key", "hit.*").join(F.broadcast(prefixes), "token")  # bounded: the templates are part of the code
    pairs = pairs.where(F.col("size") - F.col("place") >= F.col("need"))
    start = F.greatest(F.col("at") - F.col("window") + 1, F.lit(0))
    near = F.slice("near", start + 1, F.col("at") - start + F.col("window"))
    pairs = pairs.where(F.size(F.array_intersect(near, "tokens")) >= F.col("need"))
    shared = F.array_max(F.transform(F.sequence(start, F.col("at")), lambda i: F.size(F.array_intersect(F.slice("near", i + 1, F.col("window")), "tokens"))))
    return pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("need")).groupBy("text_key", "label").agg(F.max(F.col("shared") / F.col("size")).alias("share"))


def scan_licenses(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT, carry: bool = False, across_lines: bool = False,
    gram: int = 1,
) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score.

    A null or empty text has no words, no places and score 0.  The score is 1
    for a phrase, else the best template containment that meets the threshold,
    else 0.  With ``across_lines`` a notice may be wrapped, without it has to stand
    on one line.  Tokens are runs of ``gram`` words; a template of fewer words is
    refused.  Repeated rows each get a row; an empty table gives none.  Columns beside the named ones are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    if short := [k for k, t in templates.items() if not notice_grams(t, gram)]:
        raise ValueError(f"templates of fewer than {gram} words: {short}")
    vocabulary = sorted({w for t in templates.values() for w in notice_grams(t, gram)})
    none = F.array().cast("array<string>")
    out = docs.select(*([whole_row(docs)] if carry else []), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("words", alnum_words(F.col("text")))
    out = out.withColumns({f"at_{k}": _places(p) for k, p in enumerate(PHRASES)})
    out = out.withColumn("places", F.concat(*[f"at_{k}" for k in range(len(PHRASES))]))
    out = out.withColumn("base_labels", F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))))
    out = out.select(
        *(["document"] if carry else []), F.md5("text").alias("text_key"), "doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect(word_grams(F.col("words"), gram), _strings(vocabulary)).alias("vocabulary"),
        F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), "base_labels",
    )
    out = out if carry else settled(out)  # small without the texts, and read twice
    if templates:
        met = match_templates(docs, text, template_prefixes(out, templates, containment, gram), across_lines, gram)
        met = met.groupBy("text_key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))  # a label a template at most
        out = out.join(settled(met), "text_key", "left")
    else:
        out = out.withColumns({"more": F.lit(None).cast("array<string>"), "share": F.lit(None).cast("double")})
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", none))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select(*(["document"] if carry else []), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
