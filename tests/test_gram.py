"""Second moments in bounded memory, up to the size of a full-scale fit (128 clusters, 2,048 features)."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.operators import gram, subspaces
from orrery.operators.subspaces import Model


@pytest.mark.parametrize("seed", range(6))
def test_any_budget_gives_the_same_sums(seed):
    rng = np.random.default_rng(seed)
    width, k = int(rng.integers(1, 140)), 5
    one = gram.Grams(width, seed % 2 == 1, int(rng.choice([1, 3 * 8 * width * width])), int(rng.choice([1, 4000, 1 << 20])))
    x = rng.integers(-8, 9, (700, width)).astype(float)
    label = rng.choice(k, 700, p=[0.6, 0.3, 0.05, 0.05, 0.0])
    sent = []
    for lo in range(0, 700, 37):
        for c in np.unique(label[lo : lo + 37]):
            sent += list(one.add(int(c), x[lo : lo + 37][label[lo : lo + 37] == c]))
    sent += list(one.finish())
    assert not one.held and not one.waiting and one.bytes == 0
    for c in range(k):
        own = gram.Grams(width)
        passed = []
        for part, block, values in sent:
            if part == c:
                passed += list(own.take(c, block, np.asarray(values, float).ravel()))
        for _, block, values in passed:
            list(own.take(c, block, np.asarray(values, float).ravel()))
        y = x[label == c]
        assert np.array_equal(own.whole(c), y.T @ y)


FULL = """
import resource, sys
import numpy as np, pyarrow as pa
from orrery.operators import gram, subspaces
from orrery.operators.subspaces import Model

K, D, d, T = 128, 2048, 4, 20480
rng = np.random.default_rng(0)
means = rng.integers(-9, 10, (K, D)).astype(float)
class Shared:
    value = Model(means, np.zeros((K, d, D)), np.zeros((K, d)), np.zeros(K), np.zeros(K, int), np.zeros(K, bool))
label = np.where(np.arange(T) % 2 == 0, rng.integers(0, 3, T), rng.integers(0, K, T))  # half of all tokens in three clusters

def batches(only=None):
    r = np.random.default_rng(1)
    for lo in range(0, T, 1024):
        x = (means[label[lo : lo + 1024]] + r.integers(-2, 3, (1024, D))).astype(np.float32)
        if only is None:
            yield pa.record_batch({"features": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), D).cast(pa.list_(pa.float32()))})
        else:
            yield x[label[lo : lo + 1024] == only].astype(float)

sent = list(subspaces._sweep(Shared, None, True, True)(batches()))  # as the shuffle would keep it
swept = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024 - sum(b.nbytes for b in sent) / 2**20
rows = pa.Table.from_batches(sent).sort_by([(c, "ascending") for c in ("cluster", "lane", "block", "part", "seq")])
whole = {0: 0, 2: 0, 77: 0, 127: 0}

def close(met):
    if met.cluster in whole:
        ys = list(batches(met.cluster))
        y = np.concatenate(ys)
        assert met.n == len(y) and np.array_equal(met.sum, y.sum(axis=0))
        assert np.array_equal(met.grams.whole(met.cluster), y.T @ y)
        whole[met.cluster] = met.n
    yield from ()

n = sum(b.num_rows for b in gram._meet(D, True, False, lambda met, _: close(met))(iter(rows.to_batches(max_chunksize=16))))
assert min(whole.values()) > 0, whole
print(int(swept), int(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024 - 2 * sum(b.nbytes for b in sent) / 2**20))
"""


def test_a_sweep_of_full_size_stays_under_three_gigabytes():
    said = subprocess.run([sys.executable, "-c", FULL], capture_output=True, text=True, check=True, cwd=gram.__file__.rsplit("/orrery/", 1)[0]).stdout
    swept, met = map(int, said.split())
    assert swept < 3000 and met < 3000, said


def test_full_size_in_spark(spark):
    """128 clusters of 2,048 features: a product of each cluster's moments with one vector, equal to numpy."""
    k, width, each = 128, 2048, 12
    rng = np.random.default_rng(3)
    means = rng.integers(-9, 10, (k, width)).astype(float)
    model = Model(means, np.zeros((k, 0, width)), np.zeros((k, 0)), np.zeros(k), np.zeros(k, int), np.zeros(k, bool))
    v = rng.integers(-3, 4, width).astype(float)
    shared = spark.sparkContext.broadcast(means)

    def tokens(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            x = np.stack([shared.value[i % k] + np.random.default_rng(int(i)).integers(-2, 3, width) for i in ids])
            yield pa.record_batch({"features": pa.array(list(x), pa.list_(pa.float64()))})

    def close(found):
        yield pa.record_batch({"cluster": pa.array([found.cluster], pa.int32()), "n": pa.array([found.n]), "product": pa.array([found.grams.whole(found.cluster) @ v], pa.list_(pa.float64()))})

    rows = spark.range(0, k * each, 1, 4).mapInArrow(tokens, "features array<double>")
    got = {r["cluster"]: r for r in subspaces.moments(rows, model, None, True, close, "cluster int, n long, product array<double>").collect()}
    assert len(got) == k
    for c in range(k):
        x = np.stack([means[c] + np.random.default_rng(i).integers(-2, 3, width) for i in range(c, k * each, k)])
        assert got[c]["n"] == each and np.array_equal(got[c]["product"], x.T @ (x @ v))


def test_empty_and_single_tokens(spark):
    model = Model(np.zeros((2, 3)), np.zeros((2, 0, 3)), np.zeros((2, 0)), np.zeros(2), np.zeros(2, int), np.zeros(2, bool))
    one = spark.createDataFrame([([1.0, 2.0, -1.0],)], "features array<float>")
    assert subspaces.second_moments(one.where("false"), model).count() == 0
    got = {(r["i"], r["j"]): r["value"] for r in subspaces.second_moments(one, model).where(F.col("cluster") == 0).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): -1, (1, 1): 4, (1, 2): -2, (2, 2): 1}
