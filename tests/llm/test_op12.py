"""Vector codes against brute force and DuckDB."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm.codes import LEAF_POINTS, Tree, compress
from orrery.llm.codes import oracle as codes_sql
from orrery.llm.queries import op12_vector_codes


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows of (vec_id, vector, label) with whole numbers of Python."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0], kept[i][1]))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda e: (gap(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in cut:
                own.setdefault(nearest(p, v[p]), []).append(v[p])
            for e, vs in own.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = []
    for (i, _, label), v in zip(kept, cut, strict=True):
        es = [nearest(p, v[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for e in es), sum(gap(v[p], books[p][e]) for p, e in enumerate(es)), label))
    by = {}
    for _, _, error, label in coded:
        by[label] = by.get(label, 0) + error
    return sorted(((i, code, error, by[label], digest) for i, code, error, label in coded), key=str)


def found(df, **kw):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in compress(df, **kw).collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(n, width, seed, labels=3):
    rng = random.Random(seed)
    step = lambda: rng.choice((rng.gauss(0, 0.2), rng.randrange(-3, 4) / 8))  # noqa: E731  ties and repeated parts among them
    return [(i, [float(np.float32(step())) for _ in range(width)], rng.choice((None, *range(labels)))) for i in range(n)]


@pytest.mark.parametrize(("n", "width"), [(300, 16), (90, 64), (5, 8)])
def test_against_brute_force(spark, n, width):
    rows = rows_of(n, width, n)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df.repartition(3)) == found(df.coalesce(1)) == brute(rows)


def test_edges(spark):
    some = rows_of(60, 16, 3)
    bad = [(100, None, 1), (101, [], 1), (102, [None, *[0.1] * 15], 1), (103, [float("nan"), *[0.1] * 15], 2), (104, [float("inf"), *[0.1] * 15], 2), (105, [-float("inf"), *[0.1] * 15], 2)]
    odd = [(None, [0.5] * 16, None), (None, [-0.5] * 16, 7), (3, [0.25] * 16, 1), *[(200, [0.125] * 16, 1)] * 40, (-4, [0.0] * 16, None)]
    rows = [*some, *bad, *odd]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert found(spark.createDataFrame(bad, SCHEMA)) == [] and found(spark.createDataFrame([], SCHEMA)) == []
    assert compress(spark.createDataFrame([], SCHEMA)).columns == compress(spark.createDataFrame(some, SCHEMA)).columns
    wide = spark.createDataFrame(some, SCHEMA).withColumns({c: F.lit("old") for c in ("v", "code", "error", "label_error", "trees", "of", "part", "n")})
    assert found(wide) == brute(some)
    assert found(spark.createDataFrame(some, SCHEMA), parts=2, entries=5, rounds=2, scale=10) == brute(some, 2, 5, 2, 10)


def test_vectors_that_do_not_fit_fail(spark):
    for rows, word in ((([1.0] * 7), "equal parts"), (([1e30] * 8), "64 bits")):
        with pytest.raises(ValueError, match=word):
            compress(spark.createDataFrame([(1, rows, 1)], SCHEMA))
    with pytest.raises(Exception, match="8 components"):
        compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], SCHEMA)).collect()


@pytest.mark.parametrize("seed", range(6))
def test_tree_assigns_like_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 900)), int(rng.integers(1, 9))
    points = rng.integers(-6, 7, (n, width)) if seed % 2 else rng.integers(-4096, 4096, (n, width))
    if seed == 4:
        points[n // 3 :] = points[0]  # one very common vector
    book = points[rng.integers(0, n, 16)]
    tree = Tree.unpack(Tree(points).pack(), n, width)
    gaps = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    want = gaps.argmin(axis=1)
    assert (tree.nearest(book) == want).all()
    count, sums = tree.totals(book)
    assert (count == np.bincount(want, minlength=16)).all()
    assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(16))


def test_whole_subtrees_are_assigned_at_once():
    points = np.random.default_rng(1).integers(0, 4000, (4096, 2))
    book = np.array([[500, 500], [3500, 500], [500, 3500], [3500, 3500]])
    taken = list(Tree(points).filtered(book))
    whole = sum(int((end - first).sum()) for first, end, _, _ in taken if len(end) and int((end - first).max()) >= LEAF_POINTS)
    assert whole > 3500 and sum(int((end - first).sum()) for first, end, _, _ in taken) == 4096


def test_query(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    cursor = con.execute(codes_sql())
    got = sorted(tuple(r) for r in op12_vector_codes(spark, d).select(*[c[0] for c in cursor.description]).collect())
    assert got == sorted(cursor.fetchall()) and len(got) == spark.read.parquet(f"{d}/embeddings.parquet").count()
