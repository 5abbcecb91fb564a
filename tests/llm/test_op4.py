import random
import re

import numpy as np
import pytest

from orrery.llm import jaccard
from orrery.llm.graph import components
from orrery.llm.jaccard import _pack, _unpack, jaccard_components

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), least.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, n int")
    return sorted((tuple(r) for r in jaccard_components(docs, **more).collect()), key=str)


def edited(words, rng, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    common = " ".join(f"c{i}" for i in range(60))
    out = [(i, edited(base, rng, rng.choice([1, 2, 3, 4, 5]))) for i in range(100, 150)]
    out += [(i, " ".join(f"u{i}x{j}" for j in range(rng.randrange(20, 90))) + " " + common) for i in range(200, 240)]
    out += [(i, f"Short   one {i // 3}") for i in range(300, 312)] + [(7, None), (8, ""), (9, " \n"), (None, "Short one 100"), (None, None), (11, "a b c d e"), (11, "A B c d E"), (12, "a b c d"), (13, "a b c d e f")]
    out += [(400 + i, " ".join(f"chain{j}" for j in range(10 * i, 10 * i + 100))) for i in range(12)]
    out += [(5, out[0][1])] * 3 + [(600 + i, common) for i in range(5)]
    return out


def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_hot_paths_and_rounds_change_nothing(spark, rows):
    want = brute(rows)
    assert run(spark, rows, sample_rows=100, hot=2, star_rounds=0) == want
    assert run(spark, rows, sample_rows=50, hot=3, star_rounds=2, few_pairs=0) == want


def test_sample_and_empty(spark):
    got = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, got) == brute(got)
    assert run(spark, []) == []


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, 2001 + i) for i in range(50)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    label = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: label[x] for a, b in links if a != b for x in (a, b)}


def test_packing():
    nodes, sizes, counts, tokens = np.array([-5, 7]), np.array([3, 9], np.uint32), np.array([1, 2]), np.array([1, (1 << 48) - 1, 5], np.uint64)
    a, b, c = _unpack(_pack(nodes, sizes, counts, tokens))
    assert a.tolist() == [-5, 7, 7] and b.tolist() == [3, 9, 9] and c.tolist() == tokens.tolist()


def test_packed_tokens_come_back():
    import numpy as np

    from orrery.llm.jaccard import _pack, _unpack

    rng = np.random.default_rng(1)
    for most_size, most_count in ((100, 20), (70_000, 20), (100, 40_000), (1 << 31, 65_535)):
        counts = np.append(rng.integers(1, 6, 9), most_count)
        nodes, sizes = rng.integers(-(1 << 62), 1 << 62, 10), np.append(rng.integers(1, 90, 9), most_size).astype(np.uint32)
        tokens = rng.integers(0, 1 << 48, counts.sum()).astype(np.uint64)
        node, size, token = _unpack(_pack(nodes, sizes, counts, tokens))
        assert (node == np.repeat(nodes, counts)).all() and (size == np.repeat(sizes, counts)).all() and (token == tokens).all()


def test_pieces_of_a_large_component_meet_in_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(base, rng, rng.choice([1, 2, 3, 4]))) for i in range(100)] + [(1000 + i, " ".join(f"v{i // 2}x{j}" for j in range(40)) + f" {i}") for i in range(20)]
    made, made_of = [], jaccard.candidate_pairs

    def counted(*given):
        pairs = made_of(*given)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "candidate_pairs", counted)
    assert run(spark, rows) == brute(rows)
    assert made[0] <= 2 * len(rows)
