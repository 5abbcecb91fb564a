"""K affine (or linear) subspaces: the model on the driver, products on the executors.

A model is small (clusters x dim x features) and is broadcast anew in every
round.  A sweep is one map: each partition multiplies its tokens in blocks
with all bases at once, assigns them and sums the moments of its clusters in
bounded memory (``gram``); two steps merge what it sends, the first over bounded
groups of partitions.  Whether a label has changed is found by assigning under
the previous model in the same pass, so that no state has to be kept between
rounds and a lost executor costs one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import gram
from orrery.operators.sampling import hash_order
from orrery.sources.schema import MODEL, FitConfig

#: Bytes of the products of one block of tokens with all bases.
PRODUCT_BYTES = 64 << 20


@dataclass
class Model:
    """means K x D, bases K x d x D with orthonormal rows, eigenvalues K x d."""

    means: np.ndarray
    bases: np.ndarray
    eigvals: np.ndarray
    trace: np.ndarray
    counts: np.ndarray
    reseeded: np.ndarray
    linear: bool = False
    history: list[dict] = field(default_factory=list)
    final_obj_per_token: float | None = None

    @property
    def dim(self) -> int:
        return self.bases.shape[1]

    @property
    def evr(self) -> np.ndarray:
        return self.eigvals.sum(axis=1) / np.maximum(self.trace, 1e-12) if self.dim else np.zeros(len(self.means))

    def residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw residual and distance to the mean, tokens x clusters."""
        k, d, width = self.bases.shape
        sq = np.einsum("td,td->t", x, x)[:, None]
        away = sq if self.linear else sq - 2 * x @ self.means.T + np.einsum("kd,kd->k", self.means, self.means)
        away = np.broadcast_to(away, (len(x), k))
        if not d:
            return away, away
        p = (x @ self.bases.reshape(k * d, width).T).reshape(len(x), k, d)
        if not self.linear:
            p = p - np.einsum("kij,kj->ki", self.bases, self.means)
        return away - np.einsum("tkd,tkd->tk", p, p), away

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster (least id on ties) and raw residual of each token."""
        r, _ = self.residuals(x)
        best = r.argmin(axis=1)
        return best, r[np.arange(len(x)), best]

    def rows(self, spark: SparkSession) -> DataFrame:
        data = [(i, self.means[i].tolist(), self.bases[i].tolist(), self.eigvals[i].tolist(), float(self.trace[i]), int(self.counts[i]), float(self.evr[i]), None, bool(self.reseeded[i])) for i in range(len(self.means))]
        return spark.createDataFrame(data, MODEL)


def model_from(rows: DataFrame, linear: bool = False) -> Model:
    got = rows.orderBy("cluster").collect()  # one row a cluster
    width = len(got[0]["mean"])
    d = len(got[0]["eigvals"])
    pick = lambda c: np.array([r[c] for r in got], float)
    return Model(pick("mean"), pick("basis").reshape(len(got), d, width), pick("eigvals").reshape(len(got), d), pick("trace"), pick("n").astype(int), np.array([bool(r["reseeded"]) for r in got]), linear)


def matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _blocks(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut so that the products with the model's bases stay small."""
    k, d, width = model.bases.shape
    rows = min(4096, max(64, PRODUCT_BYTES // (8 * max(k * d, width))))
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield part, matrix(part.column("features"))


def _sweep(model, before, second: bool, floats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now, old = model.value, before.value if before else None
        k, width = now.means.shape
        n, obj, changed, sq = np.zeros(k, np.int64), np.zeros(k), np.zeros(k, np.int64), np.zeros(k)
        sums, grams = np.zeros((k, width)), gram.Grams(width, floats)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        sender = gram.Sender(part // gram.FAN_IN, part)
        for _, x in _blocks(batches, now):
            if not len(x):
                continue
            best, r = now.assign(x)
            last = old.assign(x)[0] if old else np.full(len(x), -1)
            for c in np.unique(best).tolist():
                at = best == c
                y = x[at]
                n[c] += len(y)
                obj[c] += np.maximum(r[at], 0).sum()
                changed[c] += int((last[at] != c).sum())
                sums[c] += y.sum(axis=0)
                sq[c] += np.einsum("td,td->", y, y)
                if second:
                    for sent in grams.add(c, y):
                        yield from sender.put(*sent)
        for sent in grams.finish():
            yield from sender.put(*sent)
        for c in np.flatnonzero(n):
            yield from sender.put(c, gram.HEAD, sums[c], n[c], changed[c], obj[c], sq[c])
        yield from sender.flush()

    return run


def moments(tokens: DataFrame, model: Model, before: Model | None, second: bool, close=gram.heads, schema: str = gram.HEADS) -> DataFrame:
    """``close`` of each cluster's counts, sums and (if ``second``) second moments under the model; counts and sums by default."""
    context = tokens.sparkSession.sparkContext
    shared, old = context.broadcast(model), context.broadcast(before) if before else None
    floats = tokens.schema["features"].dataType.elementType.typeName() == "float"
    partial = tokens.select("features").mapInArrow(_sweep(shared, old, second, floats), gram.PARTIAL)
    return gram.met(partial, model.means.shape[1], close, schema, floats)


def second_moments(tokens: DataFrame, model: Model) -> DataFrame:
    """(cluster, i, j, value), i <= j: sums of products of two features over the tokens assigned to a cluster."""
    return moments(tokens, model, None, True, gram.entries, gram.ENTRIES)


def _principal(dim: int, linear: bool):
    def close(found: gram.Met) -> Iterator[pa.RecordBatch]:
        n, mean = found.n, found.sum / found.n
        if linear:
            mean = np.zeros_like(mean)
        eig, basis = np.zeros(0), np.zeros((0, len(mean)))
        trace = max(found.sq / n - mean @ mean, 0.0)
        if dim:
            values, vectors = np.linalg.eigh(found.grams.whole(found.cluster) / n - np.outer(mean, mean))
            eig, basis = np.maximum(values[::-1][:dim], 0.0), vectors[:, ::-1][:, :dim].T
            largest = np.abs(basis).argmax(axis=1)
            basis = basis * np.where(basis[np.arange(dim), largest] < 0, -1.0, 1.0)[:, None]
        numbers = {"cluster": pa.array([found.cluster], pa.int32()), "n": pa.array([n], pa.int64()), "changed": pa.array([found.changed], pa.int64()), "obj": [found.obj], "trace": [float(trace)]}
        yield pa.record_batch(numbers | {name: pa.array([v.tobytes()], pa.binary()) for name, v in (("mean", mean), ("eig", eig), ("basis", basis))})

    return close


_PRINCIPAL = "cluster int, n long, changed long, obj double, trace double, mean binary, eig binary, basis binary"


def seeds(tokens: DataFrame, k: int, seed: int) -> DataFrame:
    """The first k tokens in hash order."""
    return tokens.withColumn("draw", hash_order(F.col("file_id"), F.col("cell_id"), seed)).orderBy("draw", "file_id", "cell_id").limit(k)


def _random_bases(k: int, d: int, width: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((width, d)))[0].T for _ in range(k)]) if d else np.zeros((k, 0, width))


def tiny_and_donors(counts: np.ndarray, least: int) -> list[tuple[int, int | None]]:
    """Clusters under ``least``, each with the donor of its rank (largest first, of twice ``least`` at least) or none."""
    tiny = np.flatnonzero(counts < least)
    donors = [int(i) for i in np.lexsort((np.arange(len(counts)), -counts)) if counts[i] >= 2 * least]
    return [(int(t), donors[i] if i < len(donors) else None) for i, t in enumerate(tiny)]


def reseeding(spark: SparkSession, model: Model, cfg: FitConfig) -> DataFrame:
    """(cluster, n, tiny, donor) of all clusters; donor is null where none is needed or left."""
    donors = dict(tiny_and_donors(model.counts, cfg.least))
    return spark.createDataFrame([(i, int(n), i in donors, donors.get(i)) for i, n in enumerate(model.counts)], "cluster int, n long, tiny boolean, donor int")


def reseed(model: Model, fresh: np.ndarray, cfg: FitConfig) -> Model:
    """Splits donors along their first axis into themselves and a tiny cluster; without a donor a token takes its place."""
    drawn = 0
    for t, donor in tiny_and_donors(model.counts, cfg.least):
        model.reseeded[t] = True
        if donor is not None and cfg.dim and not cfg.linear:
            step = np.sqrt(model.eigvals[donor, 0]) * model.bases[donor, 0]
            model.means[t], model.means[donor] = model.means[donor] - step, model.means[donor] + step
            model.bases[t], model.eigvals[t] = model.bases[donor], model.eigvals[donor]
            model.reseeded[donor] = True
        elif drawn < len(fresh):
            model.means[t] = 0 if cfg.linear else fresh[drawn]
            model.bases[t] = _random_bases(1, cfg.dim, model.means.shape[1], cfg.seed + t)[0] if cfg.linear else 0
            model.eigvals[t] = 0
            drawn += 1
    return model


def fit(tokens: DataFrame, cfg: FitConfig) -> Model:
    """K subspaces by alternating assignment and exact principal axes; ``tokens`` should be persisted.

    Clusters under ``cfg.least`` tokens are reseeded.  The loop ends after
    ``cfg.iters`` rounds or when fewer than ``cfg.tol`` of the labels change; a
    last assignment sets counts and the final objective.
    """
    first = seeds(tokens, cfg.clusters, cfg.seed).collect()  # k tokens
    width = len(first[0]["features"])
    k = len(first)
    means = np.zeros((k, width)) if cfg.linear else np.array([r["features"] for r in first], float)
    bases = _random_bases(k, cfg.dim, width, cfg.seed) if cfg.linear else np.zeros((k, cfg.dim, width))
    model = Model(means, bases, np.zeros((k, cfg.dim)), np.zeros(k), np.zeros(k, int), np.zeros(k, bool), cfg.linear)
    before, history = None, []
    for step in range(1, cfg.iters + 1):
        grouped = moments(tokens, model, before, cfg.dim > 0, _principal(cfg.dim, cfg.linear), _PRINCIPAL)
        got = {r["cluster"]: r for r in grouped.collect()}  # one row a cluster
        total = sum(r["n"] for r in got.values())
        new = Model(model.means.copy(), model.bases.copy(), model.eigvals.copy(), model.trace.copy(), np.zeros(k, int), np.zeros(k, bool), cfg.linear)
        for c, r in got.items():
            new.means[c], new.counts[c], new.trace[c] = np.frombuffer(r["mean"]), r["n"], r["trace"]
            new.eigvals[c], new.bases[c] = np.frombuffer(r["eig"]), np.frombuffer(r["basis"]).reshape(cfg.dim, width)
        sizes = np.sort(new.counts)
        history.append({
            "iter": step, "obj_per_token": sum(r["obj"] for r in got.values()) / total, "frac_changed": sum(r["changed"] for r in got.values()) / total,
            "size_min": int(sizes[0]), "size_max": int(sizes[-1]), "size_median": int(sizes[(k - 1) // 2]),
        })
        if (new.counts < cfg.least).any():
            new = reseed(new, np.array([r["features"] for r in seeds(tokens, k, cfg.seed + 1000 * step).collect()], float), cfg)
        before, model = model, new
        if history[-1]["frac_changed"] < cfg.tol:
            break
    last = moments(tokens, model, None, False).select("cluster", "n", "obj").collect()  # one row a cluster
    model.counts = np.zeros(k, int)
    for r in last:
        model.counts[r["cluster"]] = r["n"]
    model.final_obj_per_token = sum(r["obj"] for r in last) / max(sum(r["n"] for r in last), 1)
    model.history = history
    return model


def assigned(tokens: DataFrame, model: Model) -> DataFrame:
    """file_id, cell_id, label, residual, total (about the mean, or the origin) and coordinates in the cluster's subspace."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, x in _blocks(batches, m := shared.value):
            r, away = m.residuals(x)
            best = r.argmin(axis=1)
            at = np.arange(len(x))
            y = x if m.linear else x - m.means[best]
            p = np.zeros((len(x), m.dim))
            for c in np.unique(best) if m.dim else ():
                p[best == c] = y[best == c] @ m.bases[c].T
            yield pa.record_batch({
                "file_id": batch.column("file_id"), "cell_id": batch.column("cell_id"), "label": pa.array(best, pa.int32()), "residual": pa.array(r[at, best]),
                "within": pa.array(away[at, best]), "coords": pa.array(list(p), pa.list_(pa.float64())),
            })

    return tokens.select("file_id", "cell_id", "features").mapInArrow(run, "file_id int, cell_id int, label int, residual double, within double, coords array<double>")


def radii(tokens: DataFrame, model: Model) -> DataFrame:
    """(cluster, radius): the largest distance of a cluster's tokens to its mean."""
    return assigned(tokens, model).groupBy(F.col("label").alias("cluster")).agg(F.sqrt(F.max(F.greatest("within", F.lit(0.0)))).alias("radius"))


def farthest_points(tokens: DataFrame, k: int, seed: int = 0) -> Model:
    """Greedy k-center: each further centre is the token farthest from those so far."""
    first = seeds(tokens, 1, seed).collect()
    centres = [np.array(first[0]["features"], float)]
    while len(centres) < k:
        n = len(centres)
        model = Model(np.array(centres), np.zeros((n, 0, len(centres[0]))), np.zeros((n, 0)), np.zeros(n), np.zeros(n, int), np.zeros(n, bool))
        far = assigned(tokens, model).orderBy(F.desc("residual"), "file_id", "cell_id").limit(1).select("file_id", "cell_id").first()
        at = tokens.where((F.col("file_id") == far["file_id"]) & (F.col("cell_id") == far["cell_id"])).select("features").first()
        centres.append(np.array(at["features"], float))
    return Model(np.array(centres), np.zeros((k, 0, len(centres[0]))), np.zeros((k, 0)), np.zeros(k), np.zeros(k, int), np.zeros(k, bool))


#: Bytes of the tokens of which one core-set is picked, and core-sets that meet in one task.
CORE_BYTES, CORE_FAN = 64 << 20, 64


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of at most k points: the first, then always the farthest from those so far (the earliest on ties), without repeats."""
    chosen, away = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)):
        far = int(away.argmax())
        if away[far] <= 0:
            break
        chosen.append(far)
        away = np.minimum(away, ((x - x[far]) ** 2).sum(axis=1))
    return np.array(chosen)


_CORE = "lane long, file_id int, cell_id int, features array<double>"


def _cores(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        lane = TaskContext.get().partitionId() << 32

        def core() -> pa.RecordBatch:
            nonlocal lane
            rows = pa.Table.from_batches(held).sort_by([("file_id", "ascending"), ("cell_id", "ascending")]).combine_chunks()
            x = matrix(rows.column("features").combine_chunks())
            rows = rows.take(pa.array(farthest_first(x, k)))
            held.clear()
            lane += 1
            out = {"lane": pa.array(np.full(len(rows), lane), pa.int64())} | {c: rows.column(c).combine_chunks() for c in ("file_id", "cell_id")}
            return pa.record_batch(out | {"features": rows.column("features").combine_chunks().cast(pa.list_(pa.float64()))})

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= CORE_BYTES:
                yield core()
        if any(b.num_rows for b in held):
            yield core()

    return run


def _core_of_cores(k: int):
    def run(pdf):
        pdf = pdf.sort_values(["file_id", "cell_id"], kind="stable")
        return pdf.iloc[farthest_first(np.stack(pdf["features"].to_list()), k)]

    return run


def core_centres(tokens: DataFrame, k: int) -> tuple[Model, int]:
    """k-center in one pass over the tokens: centres, and the levels of core-sets they have gone through.

    Every ``CORE_BYTES`` of tokens give the k farthest of them; ``CORE_FAN`` such core-sets together give k again, until
    one is left.  Each level moves a token by at most twice the best radius, so the radius is at most 2 x levels times
    the best one, and so at most 2 x levels times that of the greedy choice over all tokens, which reads them k
    times.  Repeated tokens give fewer centres.
    """
    cores = tokens.select("file_id", "cell_id", "features").mapInArrow(_cores(k), _CORE).persist()
    kept, levels = [cores], 1
    try:
        blocks = cores.select("lane").distinct().count()
        while blocks > 1:
            lanes = -(-blocks // CORE_FAN)
            met = kept[-1].withColumn("lane", F.pmod(F.xxhash64("lane"), F.lit(lanes)) if lanes > 1 else F.lit(0).cast("long"))
            kept.append(met.groupBy("lane").applyInPandas(_core_of_cores(k), _CORE).persist())
            blocks, levels = kept[-1].select("lane").distinct().count(), levels + 1
        found = kept[-1].orderBy("file_id", "cell_id").collect()  # k tokens
    finally:
        for df in kept:
            df.unpersist()
    centres = np.array([r["features"] for r in found], float) if found else np.zeros((0, 0))
    n = len(centres)
    return Model(centres, np.zeros((n, 0, centres.shape[1])), np.zeros((n, 0)), np.zeros(n), np.zeros(n, int), np.zeros(n, bool)), levels


def reseed_plan(sizes: DataFrame, cfg: FitConfig) -> DataFrame:
    """(cluster, n, tiny, donor) from (cluster, n): the i-th cluster under the least size takes the i-th largest of twice that size; one row a cluster."""
    ranked = lambda rows, *order: rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  K rows
    tiny = ranked(sizes.where(F.col("n") < cfg.least), "cluster").select("cluster", "rank")
    donors = ranked(sizes.where(F.col("n") >= 2 * cfg.least), F.desc("n"), "cluster").select(F.col("cluster").alias("donor"), "rank")
    pairs = tiny.join(donors, "rank", "left").select("cluster", "donor")
    return sizes.join(pairs, "cluster", "left").select("cluster", "n", (F.col("n") < cfg.least).alias("tiny"), "donor")


def split_rows(model: DataFrame, plan: DataFrame) -> DataFrame:
    """(cluster, source, mean, basis, eigvals): both sides of every split, one deviation along the donor's first axis to each side.

    The tiny cluster takes the lower side, its donor the upper; both have the donor's axes.
    """
    pairs = plan.where("tiny and donor is not null").select(F.col("cluster").alias("tiny"), "donor")
    sides = pairs.select("donor", F.explode(F.array(F.struct(F.col("tiny").alias("cluster"), F.lit(-1.0).alias("sign")), F.struct(F.col("donor").alias("cluster"), F.lit(1.0).alias("sign")))).alias("side"))
    rows = sides.join(model.select(F.col("cluster").alias("donor"), "mean", "basis", "eigvals"), "donor")
    step = F.col("side.sign") * F.sqrt(F.element_at("eigvals", 1))
    moved = F.zip_with("mean", F.element_at("basis", 1), lambda m, u: m + step * u)
    return rows.select("side.cluster", F.col("donor").alias("source"), moved.alias("mean"), "basis", "eigvals")
