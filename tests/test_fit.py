import numpy as np
import pytest

from orrery.operators import affinity, holdout, subspaces, variance
from orrery.operators.subspaces import Model, assigned, fit
from orrery.sources.schema import FitConfig


def planted(k=3, d=2, width=8, each=300, noise=0.02, seed=1):
    rng = np.random.default_rng(seed)
    x, label, bases = [], [], []
    for c in range(k):
        basis = np.linalg.qr(rng.standard_normal((width, d)))[0].T
        mean = rng.standard_normal(width) * 4
        x.append(mean + rng.standard_normal((each, d)) * [3, 2][:d] @ basis + rng.standard_normal((each, width)) * noise)
        label += [c] * each
        bases.append(basis)
    return np.concatenate(x), np.array(label), bases


def frame(spark, x):
    return spark.createDataFrame([(i // 50, i % 50, v.tolist()) for i, v in enumerate(x)], "file_id int, cell_id int, features array<double>").repartition(3).persist()


def brute(model: Model, x):
    out = np.empty((len(x), len(model.means)))
    for j, (mean, basis) in enumerate(zip(model.means, model.bases, strict=True)):
        y = x if model.linear else x - mean
        out[:, j] = ((y - y @ basis.T @ basis) ** 2).sum(axis=1)
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    x, label, bases = planted()
    tokens = frame(spark, x)
    best = min((fit(tokens, FitConfig(clusters=3, dim=2, iters=20, seed=s, min_count=10)) for s in range(3)), key=lambda m: m.final_obj_per_token)
    return x, label, bases, tokens, best


def test_recovers_planted_subspaces(fitted):
    x, label, bases, _, model = fitted
    got = brute(model, x).argmin(axis=1)
    for c in range(3):
        values, counts = np.unique(got[label == c], return_counts=True)
        j = values[counts.argmax()]
        assert counts.max() > 0.95 * counts.sum()
        assert np.linalg.norm(bases[c] @ model.bases[j].T) ** 2 > 1.9
    assert model.final_obj_per_token < 0.1


def test_invariants(spark, fitted):
    x, _, _, tokens, model = fitted
    assert np.allclose(np.einsum("kid,kjd->kij", model.bases, model.bases), np.eye(2), atol=1e-8)
    assert (np.diff(model.eigvals, axis=1) <= 1e-12).all() and (model.eigvals >= 0).all()
    assert (model.eigvals.sum(axis=1) <= model.trace + 1e-9).all() and model.counts.sum() == len(x)
    rows = assigned(tokens, model).collect()
    r = brute(model, x)
    at = {(i // 50, i % 50): i for i in range(len(x))}
    for row in rows:
        i = at[row["file_id"], row["cell_id"]]
        assert row["label"] == r[i].argmin() and abs(row["residual"] - r[i].min()) < 1e-8
        assert np.allclose(row["coords"], model.bases[row["label"]] @ (x[i] - model.means[row["label"]]))
    parts = variance.decomposition(model.rows(spark)).first()
    assert abs(parts["total"] - x.var(axis=0).sum()) < 1e-6 * parts["total"]
    a = affinity.affinity_matrix(model)
    assert np.allclose(a, a.T) and np.allclose(np.diag(a), 1)
    assert sorted(affinity.seriation(a).tolist()) == [0, 1, 2]


def test_objective_never_rises_without_reseeding(spark):
    x, _, _ = planted(seed=5, noise=0.5)
    model = fit(frame(spark, x), FitConfig(clusters=3, dim=2, iters=10, min_count=1, tol=0))
    values = [h["obj_per_token"] for h in model.history]
    assert all(b <= a + 1e-9 for a, b in zip(values, values[1:], strict=False))


def test_dimension_zero_is_lloyd(spark):
    x, _, _ = planted(seed=3)
    tokens = frame(spark, x)
    cfg = FitConfig(clusters=3, dim=0, iters=4, min_count=1, tol=0)
    means = np.array([r["features"] for r in subspaces.seeds(tokens, 3, 0).collect()])
    for _ in range(4):
        label = ((x[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([x[label == c].mean(axis=0) for c in range(3)])
    model = fit(tokens, cfg)
    assert np.allclose(model.means, means) and np.allclose(model.trace, [((x[label == c] - means[c]) ** 2).sum(axis=1).mean() for c in range(3)], rtol=1e-3, atol=1e-3)
    assert model.history[0]["frac_changed"] == 1.0


def test_other_shapes(spark):
    x, _, _ = planted(each=100)
    tokens = frame(spark, x)
    one = fit(tokens, FitConfig(clusters=1, dim=3, iters=2))
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(one.eigvals[0], values[:3])
    whole = fit(tokens, FitConfig(clusters=2, dim=8, iters=2, min_count=1))
    assert whole.final_obj_per_token < 1e-8
    linear = fit(tokens, FitConfig(clusters=2, dim=2, iters=5, linear=True, min_count=1))
    assert (linear.means == 0).all() and np.isclose(linear.final_obj_per_token, brute(linear, x).min(axis=1).mean())
    with pytest.raises(ValueError):
        FitConfig(dim=0, linear=True)


def test_tiny_clusters_are_split_from_donors(spark):
    assert subspaces.tiny_and_donors(np.array([1, 500, 90, 500, 0]), 64) == [(0, 1), (4, 3)]
    assert subspaces.tiny_and_donors(np.array([1, 100]), 64) == [(0, None)]
    x, _, _ = planted(each=200)
    outlier = np.concatenate([x, np.full((1, 8), 1e3)])
    model = fit(frame(spark, outlier), FitConfig(clusters=5, dim=2, iters=6, tol=0, min_count=30))
    assert len(model.history) == 6 and model.counts.sum() == len(outlier)


def test_holdout_and_radii(spark, fitted):
    x, _, _, tokens, model = fitted
    r = brute(model, x)
    got = holdout.replay(tokens, model).first()
    assert got["n"] == len(x) and abs(got["residual"] - r.min(axis=1).sum()) < 1e-6
    assert holdout.evaluate(tokens, model, model.rows(spark)).first()["verdict"] == "generalizes"
    far = {c["cluster"]: c["radius"] for c in subspaces.radii(tokens, model).collect()}
    best = r.argmin(axis=1)
    for c in far:
        assert abs(far[c] - np.sqrt(((x[best == c] - model.means[c]) ** 2).sum(axis=1).max())) < 1e-6
    centres = subspaces.farthest_points(tokens, 3).means
    away = ((x[:, None] - centres[:2]) ** 2).sum(axis=2).min(axis=1)
    assert np.allclose(x[away.argmax()], centres[2])


def test_zero_eigenvalues_need_one_more_axis(spark):
    rows = spark.createDataFrame([(0, [9.0, 1.0]), (1, [1.0, 1.0, 1.0, 1.0]), (2, [0.0, 0.0])], "cluster int, eigvals array<double>")
    assert {r["cluster"]: r["d80"] for r in variance.effective_dims(rows).collect()} == {0: 1, 1: 4, 2: 3}


def test_reseeding_query_counts_all_tokens(spark):
    from orrery.plans.reference import QUERIES

    d = "/root/testdata/sf0.01"
    got = {r["cluster"]: r for r in QUERIES["subspace_reseeding"](spark, d).collect()}
    assert sum(r["n"] for r in got.values()) == spark.read.parquet(f"{d}/embeddings.parquet").count()
    tiny = [c for c in sorted(got) if got[c]["n"] < 64]  # max(2 * dim, 64)
    donors = sorted((c for c in got if got[c]["n"] >= 128), key=lambda c: (-got[c]["n"], c))
    assert tiny and [c for c in sorted(got) if got[c]["tiny"]] == tiny
    assert [got[c]["donor"] for c in tiny] == (donors + [None] * len(tiny))[: len(tiny)]
    assert all(got[c]["donor"] is None for c in got if c not in tiny)


def test_fitted_queries_follow_the_table(spark):
    from orrery.plans import reference

    d = "/root/testdata/sf0.01"
    model = reference._fitted(spark, d)[1]
    run = lambda name: reference.QUERIES[name](spark, d).collect()
    cum = np.cumsum(model.eigvals, axis=1) / np.maximum(model.eigvals.sum(axis=1, keepdims=True), 1e-12)
    dims = [int((c < 0.8).sum()) + 1 for c in cum]
    assert [r["d80"] for r in sorted(run("subspace_d80"))] == dims
    assert tuple(run("subspace_d80_summary")[0]) == (min(dims), sorted(dims)[(len(dims) - 1) // 2], max(dims))
    assert run("subspace_evr")[0]["evr"] == pytest.approx((model.counts * model.evr).sum() / model.counts.sum())
    (found,) = run("subspace_verdict")
    assert 0 < found["in_sample"] < 1 and found["gap"] == pytest.approx(found["held_out"] - found["in_sample"]) and found["verdict"] == ("overfit" if found["gap"] > variance.GAP else "generalizes")
    assert sorted((r["runs"], r["names"]) for r in run("sampled_runs")) == [(1, "b"), (2, "a,c")]
