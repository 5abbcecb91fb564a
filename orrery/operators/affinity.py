"""How alike clusters' subspaces are, and colours that follow it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import cosine
from orrery.operators.subspaces import Model


def centroid_cosines(model: DataFrame) -> DataFrame:
    """(i, j, cosine), i < j; the model has one row a cluster."""
    a, b = model.select(F.col("cluster").alias("i"), F.col("mean").alias("x")), model.select(F.col("cluster").alias("j"), F.col("mean").alias("y"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", cosine(F.col("x"), F.col("y")).alias("cosine"))


def point_affinity(model: DataFrame) -> DataFrame:
    return centroid_cosines(model).select("i", "j", ((1 + F.col("cosine")) / 2).alias("affinity"))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two subspaces, given by orthonormal rows: the mean squared cosine of their principal angles.

    The cosines are the singular values of the product of the bases, so the sum of their squares is its squared norm.
    """
    return float(np.square(a @ b.T).sum() / len(a))


def _pairs_of(model: Model, i: int) -> list[tuple[int, int, float, float]]:
    """(i, j, affinity, cosine) of one cluster and all later ones; points are as alike as their directions."""
    size = np.maximum(np.linalg.norm(model.means, axis=1), 1e-12)
    later = range(i + 1, len(model.means))
    near = {j: float(model.means[i] @ model.means[j] / size[i] / size[j]) for j in later}
    return [(i, j, likeness(model.bases[i], model.bases[j]) if model.dim else (1 + near[j]) / 2, near[j]) for j in later]


def subspace_affinity(spark, model: Model) -> DataFrame:
    """(i, j, affinity, cosine), i < j; each task takes some clusters and meets them with all later ones, a pair at a time."""
    shared = spark.sparkContext.broadcast(model)  # the model of the fit, broadcast there in every round

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                found = _pairs_of(shared.value, i)
                columns = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["i", "j", "affinity", "cosine"])

    return spark.range(len(model.means)).mapInArrow(run, "i int, j int, affinity double, cosine double")


def affinity_matrix(model: Model) -> np.ndarray:
    """All pairs as a symmetric matrix of ones on its diagonal, for orders and colours."""
    out = np.eye(len(model.means))
    for i in range(len(out)):
        for _, j, alike, _ in _pairs_of(model, i):
            out[i, j] = out[j, i] = alike
    return out


def affinity_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY affinity)").alias("median"), F.avg("affinity").alias("mean"), F.max("affinity").alias("most"))


def top_pairs(pairs: DataFrame, top: int = 12) -> DataFrame:
    return pairs.orderBy(F.desc(F.round("affinity", 9)), "i", "j").limit(top)


def slowest_mode(weight: np.ndarray) -> np.ndarray:
    """The eigenvector of the second smallest eigenvalue of the symmetric normalised Laplacian of a weighted graph.

    The smallest has the roots of the degrees; with that deflated, the wanted one is the leading one of the
    normalised weights.  Lanczos with full orthogonalisation finds it; where its space ends early (parts that aren't
    linked, repeated eigenvalues), it goes on from a fresh direction, so the result is exact for any graph.
    """
    k = len(weight)
    root = np.sqrt(np.maximum(weight.sum(axis=1), 1e-12))
    normal = weight / root[:, None] / root
    known = [root / np.linalg.norm(root)]  # and the Lanczos vectors after it
    rng = np.random.default_rng(0)
    diagonal, beside = [], []

    def away(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - np.array(known).T @ (np.array(known) @ v)
        return v

    v, link = away(rng.standard_normal(k)), 0.0
    while len(known) < k:
        known.append(v / np.linalg.norm(v))
        if diagonal:
            beside.append(link)
        w = normal @ known[-1]
        diagonal.append(float(known[-1] @ w))
        v = away(w)
        link = float(np.linalg.norm(v))
        if link < 1e-10:
            v, link = away(rng.standard_normal(k)), 0.0
    modes = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))[1]
    return np.array(known[1:]).T @ modes[:, -1]


def seriation(affinity: np.ndarray, walk: bool = True) -> np.ndarray:
    """Each cluster's rank along the slowest mode of the affinities (diagonal left out); its largest coordinate is positive.

    Without ``walk`` the mode is the Fiedler vector itself, by which maps and the registered query order and colour
    clusters; with it, each coordinate is divided by the root of the cluster's degree (the mode of a random walk
    between clusters), which also keeps the weakly linked ends of a chain in their place.
    """
    k = len(affinity)
    if k < 3:
        return np.arange(k)
    weight = np.array(affinity, float)
    np.fill_diagonal(weight, 0)
    line = slowest_mode(weight)
    if walk:
        line = line / np.sqrt(np.maximum(weight.sum(axis=1), 1e-12))
    if line[np.abs(line).argmax()] < 0:
        line = -line
    return np.argsort(np.argsort(line, kind="stable"), kind="stable")


def rainbow(t: np.ndarray) -> np.ndarray:
    """RGB of positions in [0, 1]: a smooth blue - green - red ramp of equal steps in hue."""
    hue = (1 - np.clip(np.asarray(t, float), 0, 1)) * 240 / 60
    up = lambda shift: np.clip(2 - np.abs(hue - shift), 0, 1)
    red = np.clip(np.maximum(2 - hue, 0), 0, 1)
    return np.stack([red, up(2), np.clip(hue - 2, 0, 1)], axis=1)


# The published polynomial approximation of the turbo colour map, rising powers by channel.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)


def turbo(t: np.ndarray) -> np.ndarray:
    """RGB of positions in [0, 1]."""
    x = np.clip(np.asarray(t, float), 0, 1)
    return np.clip(np.stack([np.polynomial.polynomial.polyval(x, c) for c in TURBO], axis=1), 0, 1)


def colours(affinity: np.ndarray) -> np.ndarray:
    """RGBA by seriation rank; a single cluster has the middle colour."""
    k = len(affinity)
    t = seriation(affinity, walk=False) / (k - 1) if k > 1 else np.array([0.5])
    return np.concatenate([turbo(t), np.ones((k, 1))], axis=1)
