"""Operators 6, 9 and 10 against plain Python."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from orrery.llm import quality
from orrery.llm.licenses import PHRASES, scan_licenses
from orrery.llm.quality import judge_quality
from orrery.llm.queries import ORACLES, QUERIES
from orrery.llm.urls import RULES, judge_urls

SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t", "All  rights-reserved. cc\nby CC BY", "a " * 9, "one two three four five six seven eight nine\n" * 12, "x\n\nx\nx \n#*$ & |<>%", "accc by", "cc by\u00e9", "K\u212a general public license",
         "Licensed under CC BY-NC 4.0.\nfoo", "released under the MIT License.", " ".join(f"w{i}" for i in range(20000)), "the,*** in%%% on%%% " * 10 + " ".join(f"q{i}" for i in range(30)), "NO!! YES!! " + " ".join(f"w{i}!!" for i in range(60)),
         "Wh Wh Wh Wh th th th th " + " ".join(f"{c} " * 7 for c in "abcdefghijk")]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "all rights reserved", 1, "x"), (3, "repeat", 1, "x"), (3, "repeat", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, windows string")


def base_quality(text):
    text = text or ""
    w = SOLID.findall(text)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [s for s in text.split("\n") if SOLID.search(s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality_base(spark):
    got = judge_quality(frame(spark, TEXTS), carry=True).select("document.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(TEXTS) + 3
    for text, *rest, kept in got:
        assert tuple(rest) == base_quality(text), text
        assert not (kept and rest[-1])
    kept = {r[0]: r[-1] for r in got}
    assert kept[TEXTS[12]] and not any(kept[t] for t in TEXTS[13:16])


def test_quality_order_never_changes_verdicts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = judge_quality(docs).select("doc_id", "kept").collect()
    monkeypatch.setattr(quality, "rank_rules", lambda docs, text, tried, rows: tried[::-1])
    assert sorted(first) == sorted(judge_quality(docs).select("doc_id", "kept").collect())


def test_quality_oracle_and_empty(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op10_quality_rules']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in QUERIES["op10_quality_rules"](spark, SMALL).select(names).collect())
    assert judge_quality(frame(spark, []).limit(0)).count() == 0


def base_license(text):
    w = ALNUM.findall(fold(text))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, sorted({label for _, label in found})


def test_license_base(spark):
    got = scan_licenses(frame(spark, TEXTS), carry=True).select("document.text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert len(got) == len(TEXTS) + 3
    for text, *base, labels, score in got:
        assert tuple(base) == base_license(text), text
        assert set(base[-1]) <= set(labels) and 0 <= score <= 1 and (score > 0) == bool(labels)
    labels = {r[0]: r["labels"] for r in got}
    assert labels[TEXTS[10]] == ["cc-by", "cc-by-nc"] and labels[TEXTS[11]] == ["mit"]


def test_license_join_is_exact(spark):
    templates = {"a": "one two three four five", "b": "five six seven", "c": "x"}
    texts = ["one two three four", "one two three\nfour five", "Five-six seven", "five six", "x\ny", "five four three two zero one", "seven six five four three two one x"]
    want = {t: sorted(k for k, s in templates.items() if any(5 * len(set(ALNUM.findall(fold(line))) & set(s.split())) >= 4 * len(set(s.split())) for line in t.split("\n"))) for t in texts}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in scan_licenses(docs, templates=templates, carry=True).select("document.text", "labels").collect()}
    assert got == want
    assert scan_licenses(docs.limit(0), templates=templates).count() == 0


URLS = [None, "", "no scheme", "http://A.Example.ORG/en/1x?q#f", "http://example.org/en/2", "https://example.org", "http://example.org/es/9", "ftp://x.com/fr/1", "x.com/de/1", "x://x.com/de/1", "http://notorg/", "http://org/", "http://a.net/?x://b", "u://H#a/b?c", "http://a.com/DE/1", "http://www.com.net/de/"]


def url_base(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = fold(host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.rule), default=None)
    return host, path, best and best.rule, best and ("allow" if best.allow else "block")


def test_urls(spark):
    rows = [(i, u, 1) for i, u in enumerate(URLS)] + [(None, URLS[3], 1), (3, URLS[3], 1), (3, URLS[3], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = judge_urls(pages, carry=True).select("document.url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(rows)
    for url, *rest, verdict in got:
        host, path, rule, known = url_base(url)
        assert tuple(rest) == (host, path, rule) and verdict in ("allow", "block") and verdict == (known or verdict), url
    assert judge_urls(pages.limit(0)).count() == 0


def test_url_model_matches_plain_computation(spark):
    import math

    urls = [f"http://a{i}.org/en/{i * 37 % 90}" for i in range(60)] + [f"http://b{i}.com/de/zz{i}" for i in range(40)] + [f"http://c{i}.net/{'zz' if i % 2 else 'en'}/{i}" for i in range(20)]
    order, start, end = 3, "\x02", "\x03"
    text = lambda u: "".join(url_base(u)[:2])
    counts = {"allow": Counter(), "block": Counter()}
    for u in urls:
        if known := url_base(u)[3]:
            s = start * (order - 1) + text(u) + end
            counts[known].update((k, s[i + order - 1 - k : i + order]) for i in range(len(s) - order + 1) for k in range(order))
    contexts = {c: {} for c in counts}
    for c in counts:
        for (k, g), n in counts[c].items():
            total, kinds = contexts[c].get((k, g[:k]), (0, 0))
            contexts[c][k, g[:k]] = total + n, kinds + 1

    def score(u):
        s, out = start * (order - 1) + text(u) + end, []
        for i in range(len(s) - order + 1):
            p = {}
            for c in counts:
                p[c] = 1 / 256
                for k in range(order):
                    g = s[i + order - 1 - k : i + order]
                    total, kinds = contexts[c].get((k, g[:k]), (0, 0))
                    p[c] = (counts[c][k, g] + kinds * p[c]) / (total + kinds) if total else p[c]
            out.append(math.log(p["allow"]) - math.log(p["block"]))
        return sum(out) / len(out)

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = judge_urls(pages, order=order).where(F.col("rule").isNull()).collect()
    assert len(got) == 20
    for r in got:
        assert abs(r["score"] - score(urls[r["page_id"]])) < 1e-5


def test_license_windows(spark, tmp_path):
    from orrery.llm.licenses import TEMPLATES

    texts = {
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that": ["bsd"],
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy": ["mpl-2.0"],
        "released " + "w " * 40 + "under the " + "w " * 40 + "mit license": [],
        "released under the MIT License " + "w " * 3000 + "released under": ["mit"],
        "w\n" * 30 + "permission is hereby granted, free of charge,\n\n" + "to any person obtaining a copy\n" + "of software": ["mit-grant"],
        "no notice": [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["labels"] for r in QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [",".join(v) for v in texts.values()]

    def brute(text):
        words = ALNUM.findall(fold(text))
        return sorted(k for k, s in TEMPLATES.items() for n in [2 * len(s.split())] if any(5 * len(set(words[i : i + n]) & set(s.split())) >= 4 * len(set(s.split())) for i in range(len(words))))

    import random

    rng = random.Random(3)
    pool = [" ".join(w for w in s.split() for _ in range(rng.choice([0, 1, 1, 1, 1]))) for s in [*TEMPLATES.values()] * 3] + ["w " * n for n in range(1, 12)]
    more = ["\n".join(rng.choice(pool) + " w" * rng.randrange(9) for _ in range(6)) for _ in range(60)]
    found = scan_licenses(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), across_lines=True)
    assert {r["doc_id"]: sorted(set(r["labels"]) - set(r["base_labels"])) for r in found.collect()} == {i: [k for k in brute(t) if k not in PHRASES.values()] for i, t in enumerate(more)}


def test_license_words_in_prose_are_no_notice(spark, tmp_path):
    texts = {
        "The new wing was released to visitors under the old license of the city council last spring": "",
        "Licensed under the Mozilla license version 2.0": "",
        "This domain is public, and the work of the mayor is released into it every week": "",
        "# Licensed under the Apache\n# License, Version 2.0 (the License);\n# you may not use this file except\n# in compliance with the License.": "apache-2.0,apache-header",
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software": "mit-grant",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING": "mit-warranty",
        "word " * 60000 + "released under the MIT License " + "word " * 60000: "mit",
    }
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == list(texts.values()) and got[6]["n_words"] == 120005


def test_quality_reruns_agree_and_long_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(judge_quality(docs).select("doc_id", "failed_rule").collect(), key=str) == sorted(judge_quality(docs.repartition(3)).select("doc_id", "failed_rule").collect(), key=str)
    long = " ".join(f"w{i}" for i in range(200000))
    got = judge_quality(spark.createDataFrame([(1, long), (2, "same " * 100000)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in got) == [(1, 200000, 0, False), (2, 100000, 100000, True)]


def test_url_threshold_is_held_out(spark):
    """Undecided URLs go with the class whose paths they resemble, though none of the calibrating URLs has trained the models."""
    rng = __import__("random").Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(12))
    urls = [f"http://{word('abcde')}.org/{word('abcde')}" for _ in range(150)] + [f"http://{word('vwxyz')}.com/de/{word('vwxyz')}" for _ in range(150)]
    urls += [f"http://{word('abcde')}.net/{word('abcde')}" for _ in range(20)] + [f"http://{word('vwxyz')}.net/{word('vwxyz')}" for _ in range(20)] + ["http://a.net/" + "abc" * 20000]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert sum(got[i] == "allow" for i in range(300, 320)) >= 18 and sum(got[i] == "block" for i in range(320, 340)) >= 18 and got[340] == "allow"


def test_license_query_is_an_exact_join_of_word_pairs(spark, tmp_path):
    """The registered query against all windows of all texts, a notice with a word left out, and one-line declarations."""
    import random

    from orrery.llm.licenses import DECLARATIONS, TEMPLATES

    notices = {**TEMPLATES, **DECLARATIONS}
    pairs = lambda words: list(zip(words, words[1:], strict=False))

    def brute(text):
        have = pairs(ALNUM.findall(fold(text)))
        want = {k: pairs(s.split()) for k, s in notices.items()}
        return {k for k, w in want.items() if any(5 * len(set(have[i : i + 2 * len(w)]) & set(w)) >= 4 * len(set(w)) for i in range(len(have)))}

    rng = random.Random(5)
    pool = [" ".join(w for w in s.split() if rng.random() < 0.94) for s in [*notices.values()] * 3]
    fixed = {
        "Permission is granted, free of charge, to any person obtaining a copy of this software": "mit-grant",
        "License: MIT": "license-mit",
        "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;": "spdx-gpl-2.0",
        "Use it under GPL v2 or later.": "gpl-2-line",
        "SPDX-License-Identifier: MIT": "spdx-mit",
        "license": "",
        "the mit": "",
        "Under the terms of the public; license is gnu, lesser, general, published by software free as the foundation": "",
    }
    texts = [*fixed, *("\n".join(rng.choice(pool) + " w" * rng.randrange(9) for _ in range(6)) for _ in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["labels"] for r in QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(fixed))] == list(fixed.values())
    for i, text in enumerate(texts):
        assert set(filter(None, got[i].split(","))) == brute(text) | set(base_license(text)[-1]), text
    assert sum(bool(v) for v in got.values()) > 40


def test_url_hot_grams_change_nothing(spark, monkeypatch):
    """Every gram hot, none hot, and the registered bound give the same scores and verdicts, and a row for each page."""
    from orrery.llm import urls

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = []
    for most in (10**9, 1, urls.MOST_HOT):
        monkeypatch.setattr(urls, "MOST_HOT", most)
        found.append(sorted(map(str, judge_urls(pages).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == pages.count()
