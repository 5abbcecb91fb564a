"""Core-sets, spectral order, cells at half, re-seeding relations and comparison of all runs, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import affinity, compare, spatial, subspaces, variance
from orrery.sources.schema import FitConfig


def frame(spark, x, parts=3):
    rows = [(i // 10, i % 10, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "file_id int, cell_id int, features array<double>").repartition(parts)


def radius(x, centres):
    return float(np.sqrt(((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).max()))


def greedy(x, k, first=0):
    chosen = [first]
    while len(chosen) < k:
        chosen.append(int(((x[:, None] - x[chosen]) ** 2).sum(axis=2).min(axis=1).argmax()))
    return x[chosen]


@pytest.mark.parametrize(("seed", "parts", "k"), [(0, 1, 4), (1, 7, 5), (2, 16, 3), (3, 70, 6)])
def test_core_sets_stay_within_their_factor(spark, seed, parts, k):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_normal((200, 5)) * s + rng.standard_normal(5) * 8 for s in (0.1, 1, 3)])
    model, levels = subspaces.core_centres(frame(spark, x, parts), k)
    assert len(model.means) == k and levels == (1 if parts == 1 else 2 if parts <= 64 else 3)
    assert all((x == m).all(axis=1).any() for m in model.means)
    for first in range(0, len(x), 97):
        assert radius(x, model.means) <= 2 * levels * radius(x, greedy(x, k, first)) + 1e-9
    far = subspaces.radii(frame(spark, x, parts), model).agg(F.max("radius")).first()[0]
    assert far == pytest.approx(radius(x, model.means), abs=1e-6)


def test_core_sets_of_few_and_repeated_tokens(spark):
    x = np.repeat(np.arange(3.0)[:, None] * 5, 40, axis=0)
    model, _ = subspaces.core_centres(frame(spark, x, 5), 10)
    assert sorted(model.means[:, 0].tolist()) == [0, 5, 10]
    empty, levels = subspaces.core_centres(frame(spark, x).where("false"), 4)
    assert len(empty.means) == 0 and levels == 1
    assert subspaces.farthest_first(np.array([[0.0], [4.0], [2.0], [-4.0]]), 3).tolist() == [0, 1, 3]  # the earliest on ties


@pytest.mark.parametrize("seed", range(8))
def test_order_is_the_fiedler_rank(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(3, 70))
    w = rng.random((k, k)) ** 3
    w = (w + w.T) / 2
    np.fill_diagonal(w, 1)
    off = w - np.diag(np.diag(w))
    root = np.sqrt(off.sum(axis=1))
    line = np.linalg.eigh(np.eye(k) - off / root[:, None] / root)[1][:, 1]
    line = line if line[np.abs(line).argmax()] > 0 else -line
    assert (affinity.seriation(w, walk=False) == np.argsort(np.argsort(line))).all()
    mode = affinity.slowest_mode(off)
    assert np.allclose(np.abs(mode), np.abs(line), atol=1e-7) and (w.diagonal() == 1).all()


def test_order_of_parts_that_are_not_linked():
    blocks = np.kron(np.eye(3), np.ones((2, 2)))
    rank = affinity.seriation(blocks, walk=False)
    assert sorted(rank.tolist()) == list(range(6)) and sorted(affinity.seriation(np.zeros((5, 5)), walk=False).tolist()) == list(range(5))


def test_cells_at_half_by_histogram(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), int(label)) for label in range(6) for c in rng.zipf(1.3 + label / 4, 50 * 3**label % 700 + 1) % 40]
    got = {r["label"]: r["cells50"] for r in spatial.cells_at_half(spark.createDataFrame(rows, "cell_id int, label int"), 8, 40).collect()}
    for label in range(6):
        counts = sorted(Counter(c for c, k in rows if k == label).values(), reverse=True)
        assert got[label] == sum(2 * s < sum(counts) for s in np.cumsum(counts)) + 1
    assert got[6] == got[7] == 41


def test_no_window_goes_over_cells(spark):
    plan = spatial.cells_at_half(spark.createDataFrame([(1, 1)], "cell_id int, label int"), 2, 10)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window") :]
    assert plan.count("Window") >= 1 and below.count("Aggregate") >= 2  # the histogram's aggregate stands between window and cells


def test_reseeding_relations_are_those_of_the_fit(spark):
    rng = np.random.default_rng(6)
    for counts in (rng.integers(0, 300, 12), np.array([5, 0, 500]), np.array([100, 100]), np.array([3, 4, 5])):
        cfg = FitConfig(clusters=len(counts), dim=2, min_count=64)
        want = dict(subspaces.tiny_and_donors(counts, cfg.least))
        plan = subspaces.reseed_plan(spark.createDataFrame([(i, int(n)) for i, n in enumerate(counts)], "cluster int, n long"), cfg)
        got = {r["cluster"]: r for r in plan.collect()}
        assert len(got) == len(counts)
        assert all(got[c]["tiny"] == (c in want) and got[c]["donor"] == want.get(c) for c in got)
        bases = np.stack([np.linalg.qr(rng.standard_normal((4, 2)))[0].T for _ in counts])
        model = subspaces.Model(rng.standard_normal((len(counts), 4)), bases, rng.random((len(counts), 2)) + 0.5, np.ones(len(counts)), counts.copy(), np.zeros(len(counts), bool))
        sides = {r["cluster"]: r for r in subspaces.split_rows(model.rows(spark), plan).collect()}
        after = subspaces.reseed(model, np.zeros((0, 4)), cfg)
        assert set(sides) == {c for pair in want.items() if pair[1] is not None for c in pair}
        for c, r in sides.items():
            assert np.allclose(r["mean"], after.means[c]) and np.allclose(r["basis"], after.bases[c]) and np.allclose(r["eigvals"], after.eigvals[c])


def test_agreement_of_all_pairs_equals_that_of_each(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 5, 400)
    rows = [(int(v), int((v + rng.integers(0, 2)) % 5), int(rng.integers(0, 3)), 1, None if i % 7 == 0 else int(v)) for i, v in enumerate(x)]
    runs = ["one", "two", "three", "same", "holes"]
    df = spark.createDataFrame(rows, ", ".join(f"{r} int" for r in runs))
    got = {(r["run_a"], r["run_b"]): r for r in compare.agreements(compare.run_pairs(df, runs)).collect()}
    assert len(got) == 10
    for (a, b), r in got.items():
        both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        assert r["tokens"] == both.count()
        assert r["nmi"] == pytest.approx(compare.nmi(both, a, b).first()[0], abs=1e-9) and r["ari"] == pytest.approx(compare.ari(both, a, b).first()[0], abs=1e-9)
    trivial = spark.createDataFrame([(1, 2)] * 3, "p int, q int")
    assert tuple(compare.agreements(compare.run_pairs(trivial, ["p", "q"])).first())[2:] == (3, 1.0, 1.0)
    assert compare.agreements(compare.run_pairs(trivial.where("false"), ["p", "q"])).count() == 0


def test_cards_of_runs(spark):
    x = np.random.default_rng(2).standard_normal((400, 6))
    tokens = frame(spark, x).persist()
    model = subspaces.fit(tokens, FitConfig(clusters=3, dim=2, iters=3, min_count=5))
    rows, history = model.rows(spark), spark.createDataFrame(model.history)
    labels = subspaces.assigned(tokens, model).select("file_id", "cell_id", "label")
    cards = [compare.run_card(name, rows, history, labels, 5, final).first() for name, final in (("final", model.final_obj_per_token), ("history", None))]
    assert [c["objective"] for c in cards] == [model.final_obj_per_token, model.history[-1]["obj_per_token"]]
    (card, _), split = cards, variance.decomposition(rows).first()
    assert card["between_share"] == pytest.approx(split["between_share"]) and card["evr_median"] == pytest.approx(sorted(model.evr)[1])
    assert card["smallest"] == model.counts.min() and card["tiny"] == (model.counts < 5).sum() and card["most_d80"] in (1, 2) and card["jan_jul"] is None
    assert math.isclose(sum(card[c] for c in ("between_share", "captured_share", "residual_share")), 1)
    tokens.unpersist()
