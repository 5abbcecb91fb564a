import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from orrery.llm.repeats import remove_repeats, repeated_windows, sliding_least

DATA = "/root/testdata/sf0.001"


def brute(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=False) if not g)).hexdigest()))
    return out


def run(spark, texts, span, **more):
    docs = spark.createDataFrame([(i, t, 1, b"") for i, t in enumerate(texts)], "doc_id long, text string, row int, kept binary")
    got = sorted(remove_repeats(docs, span=span, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    return [tuple(r)[1:] for r in got]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(40))
    make = lambda n: " ".join(word() for _ in range(n))
    out = [make(rng.randrange(0, 90)) + passage[rng.randrange(20) : rng.randrange(60, len(passage))] + make(rng.randrange(0, 50)) for _ in range(60)]
    out += [out[0]] * 3 + [None, "", "ab" * 200, "a" * 500, "x" + "a" * 39, "a" * 40, out[1] + out[1], make(3000), "short", "short"]
    near = make(300)
    out += [near[:k] + "#" + near[k + 1 :] for k in rng.sample(range(len(near)), 12)]
    return out


def test_against_brute_force(spark, texts):
    assert run(spark, texts, 40, gram=16, block=5) == brute(texts, 40)


def test_crowded_anchors(spark, texts):
    assert run(spark, texts, 40, gram=16, block=8, most_variants=3) == brute(texts, 40)


def test_sample_and_empty(spark):
    got = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").select("text").collect()]
    assert run(spark, got, 400) == brute(got, 400)
    assert run(spark, [], 400) == []


def test_merged_transforms():
    rng = random.Random(1)
    for shards in (1, 2, 3):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(30)]
        seen = Counter(s[i : i + 12] for s in strings for i in range(len(s) - 11))
        want = [[i for i in range(len(s) - 11) if seen[s[i : i + 12]] > 1] for s in strings]
        assert [w.tolist() for w in repeated_windows(strings, 12, 3, shards)] == want


def test_sliding_least():
    v = np.random.default_rng(2).integers(0, 50, 200).astype(np.uint64)
    assert sliding_least(v, 7).tolist() == [v[i : i + 7].min() for i in range(194)]


def test_shorter_passages(spark, texts):
    """Strings of three quarters of a span are counted, exactly and by either way of crowded anchors."""
    for more in ({}, {"most_variants": 3}):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sorted(remove_repeats(docs, span=40, gram=16, block=5, **more).select("doc_id", "n_passage").collect())
        assert [n for _, n in got] == [n for _, n, *_ in brute(texts, 30)]


def test_periodic_texts(spark):
    """Runs of one character or of a short period are few bounded snippets, however long."""
    from orrery.llm.repeats import PIECE, anchors

    for period in (b"=", b"ab", b"0123456789" * 7, bytes(range(256)) * 2):
        data = np.frombuffer((period * 200_000)[:200_000], np.uint8)
        row, key, first, last, places = anchors(data, np.array([0, len(data)]), 300, 100)
        assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == len(data) - 300 and (last - first).max() < PIECE
        assert len(row) <= 10 or len(period) > 300
    long = "=" * 10_000_000
    rng = random.Random(4)
    odd = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    got = run(spark, [long, odd, odd[:700] + "~" * 450, "-" * 399, "x-" * 250], 400)
    assert got[0][:3] == (10_000_000, 10_000_000, 1) and got[1][:3] == (3000, 700, 1) and got[2][:3] == (1150, 1150, 1) and got[3][:3] == (399, 0, 0) and got[4][:3] == (500, 500, 1)


def test_ties_and_null_ids(spark):
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefgh ") for _ in range(500))
    docs = spark.createDataFrame([(None, body), (None, body), (7, body), (7, "short"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in remove_repeats(docs, keep_bytes=True).select("doc_id", "n_bytes", "n_removed", "n_passage").collect()), key=str)
    assert got == sorted([(None, 500, 500, 500)] * 2 + [(7, 500, 500, 500), (7, 5, 0, 0), (None, 0, 0, 0)], key=str)
