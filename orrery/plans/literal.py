"""Queries of subspaces of dimension above 0 with SQL: both engines start from the same orthonormal bases.

Cluster c has the rows c + 1, c + 2 and c + 3 of a Hadamard matrix over 8 as its basis, the mean of the tokens of label c,
and as eigenvalues their variances along the axes.  So the operators are tested on the given tokens, without an eigensolver.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import calendar, healpix
from orrery.functions.vectors import dot, squared_norm
from orrery.operators import affinity, compare, grid, holdout, programs, sampling, spatial, subspaces, variance, vectors
from orrery.plans.reference import ASSIGN, CELLS, DOMINANT, K, NEST, NSIDE, TOKENS, X, query, rounded
from orrery.sources import load, store
from orrery.sources.schema import HISTORY, FitConfig, HoldoutConfig

DIM, AXES = X.TOKEN_DIM, 3
CONFIG = FitConfig(clusters=X.TOKEN_CLUSTERS, dim=AXES, min_count=32)
#: Clusters from this on are moved by 1 along the first feature in the re-seeding queries, so that they are left nearly empty.
FAR = 7


def hadamard(row: int) -> list[float]:
    return [(-1.0) ** (row & d).bit_count() / DIM**0.5 for d in range(DIM)]


def bases(spark) -> DataFrame:
    rows = [(c, [hadamard(c + 1 + a) for a in range(AXES)]) for c in range(X.TOKEN_CLUSTERS)]
    return spark.createDataFrame(rows, "cluster int, basis array<array<double>>")


def literal_model(spark, tokens: DataFrame, linear: bool = False, far: bool = False) -> DataFrame:
    """The model's rows over labelled tokens."""
    model = vectors.centroids(tokens).join(F.broadcast(bases(spark)), "cluster")
    if linear:
        model = model.withColumn("mean", F.transform("mean", lambda _: F.lit(0.0)))
    if far:
        model = model.withColumn("mean", F.transform("mean", lambda x, i: x + F.when((F.col("cluster") >= FAR) & (i == 0), 1.0).otherwise(0.0)))
    rows = tokens.join(F.broadcast(model.select(F.col("cluster").alias("label"), "mean", "basis")), "label")
    away = F.zip_with("features", "mean", lambda a, b: a - b)
    coords = F.transform("basis", lambda u: dot(away, u))
    spread = [F.avg(F.pow(F.element_at("p", i + 1), 2)).alias(f"e{i}") for i in range(AXES)]
    sums = rows.select("label", squared_norm(away).alias("sq"), coords.alias("p")).groupBy("label").agg(F.avg("sq").alias("trace"), *spread)
    eig = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"e{i}").alias("e"), F.lit(-i).alias("i")) for i in range(AXES)])))
    model = model.join(sums.withColumnRenamed("label", "cluster"), "cluster").withColumn("eig", eig)
    basis = F.transform("eig", lambda x: F.element_at("basis", 1 - x["i"]))
    return model.select("cluster", "mean", basis.alias("basis"), F.transform("eig", lambda x: x["e"]).alias("eigvals"), "trace", "n", F.lit(False).alias("reseeded")).withColumn("evr", F.aggregate("eigvals", F.lit(0.0), lambda s, x: s + x) / F.greatest("trace", F.lit(1e-12)))


def _model(spark, d, linear=False):
    tokens = X.tokens(spark, d)
    return tokens, literal_model(spark, tokens, linear)


def _frozen(spark, d, linear=False):
    tokens, rows = _model(spark, d, linear)
    return tokens, subspaces.model_from(rows, linear)


def lit_sql(mean: str = "m", where: str = "true") -> str:
    """had (all axes), fit (labelled tokens of the model), eig, lit, and proj / away / res / best of the judged tokens."""
    return f"""{TOKENS}, used AS (SELECT * FROM long WHERE {where}), lm AS (SELECT label AS cluster, dim, avg(v) AS m FROM used GROUP BY label, dim),
had AS (SELECT CAST(c AS INTEGER) AS cluster, CAST(a AS INTEGER) AS axis, CAST(d AS INTEGER) AS dim, CASE WHEN bit_count(CAST((c + a + 1) & d AS INTEGER)) % 2 = 0 THEN 0.125 ELSE -0.125 END AS u FROM range({X.TOKEN_CLUSTERS}) x(c), range({AXES}) y(a), range({DIM}) z(d)),
base AS (SELECT cluster, dim, {mean} AS m FROM lm),
own AS (SELECT token_id, label AS cluster, axis, sum((v - m) * u) AS p FROM used JOIN base ON base.cluster = label AND used.dim = base.dim JOIN had ON had.cluster = label AND had.dim = used.dim GROUP BY ALL),
eig AS (SELECT cluster, axis, avg(p * p) AS e FROM own GROUP BY ALL),
tr AS (SELECT label AS cluster, sum((v - m) * (v - m)) / count(DISTINCT token_id) AS trace, count(DISTINCT token_id) AS n FROM used JOIN base ON cluster = label AND used.dim = base.dim GROUP BY label),
lit AS (SELECT cluster, max(n) AS n, max(trace) AS trace, sum(e) AS captured FROM tr JOIN eig USING (cluster) GROUP BY cluster)"""


def judged_sql(where: str = "true") -> str:
    return f"""proj AS (SELECT token_id, cluster, axis, sum((v - m) * u) AS p FROM long JOIN base USING (dim) JOIN had USING (cluster, dim) WHERE {where} GROUP BY ALL),
away AS (SELECT token_id, cluster, sum((v - m) * (v - m)) AS w FROM long JOIN base USING (dim) WHERE {where} GROUP BY ALL),
res AS (SELECT token_id, cluster, w, w - q AS r FROM away JOIN (SELECT token_id, cluster, sum(p * p) AS q FROM proj GROUP BY ALL) USING (token_id, cluster)),
best AS (SELECT token_id, cluster, w, r FROM res QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY r, cluster) = 1)"""


LIT, LINEAR, JUDGED = lit_sql(), lit_sql("0.0"), judged_sql()


@query(f"WITH {LIT}, {JUDGED} SELECT file_id, cell_id, cluster AS label, round(r, 6) AS residual, round(w, 6) AS within FROM best JOIN tokens USING (token_id)")
def literal_residual(spark, d):
    return rounded(subspaces.assigned(*_frozen(spark, d)).drop("coords"))


@query(f"WITH {LINEAR}, {JUDGED} SELECT file_id, cell_id, cluster AS label, round(r, 6) AS residual FROM best JOIN tokens USING (token_id)")
def literal_linear_residual(spark, d):
    return rounded(subspaces.assigned(*_frozen(spark, d, True)).select("file_id", "cell_id", "label", "residual"))


@query(f"WITH {LIT}, {JUDGED}, place AS (SELECT cluster, axis, CAST(row_number() OVER (PARTITION BY cluster ORDER BY e DESC, axis) - 1 AS INTEGER) AS i FROM eig) SELECT file_id, cell_id, i, round(p, 6) AS coord FROM best JOIN proj USING (token_id, cluster) JOIN place USING (cluster, axis) JOIN tokens USING (token_id)")
def literal_coords(spark, d):
    return rounded(subspaces.assigned(*_frozen(spark, d)).select("file_id", "cell_id", F.posexplode("coords").alias("i", "coord")))


@query(f"WITH {LIT}, {JUDGED} SELECT cluster, count(*) AS n, round(sum(greatest(r, 0)), 6) AS obj FROM best GROUP BY cluster")
def literal_sweep(spark, d):
    """What one sweep of the fit sums for each cluster."""
    tokens, model = _frozen(spark, d)
    return rounded(subspaces.moments(tokens, model, None, True).select("cluster", "n", "obj"))


@query(f"WITH {LIT} SELECT a.cluster AS i, b.cluster AS j, round(sum(pow(d, 2)) / {AXES}, 6) AS affinity FROM (SELECT a.cluster AS x, b.cluster AS y, sum(a.u * b.u) AS d FROM had a JOIN had b ON a.dim = b.dim AND a.cluster < b.cluster GROUP BY a.cluster, a.axis, b.cluster, b.axis) p, (SELECT DISTINCT cluster FROM lm) a, (SELECT DISTINCT cluster FROM lm) b WHERE a.cluster = x AND b.cluster = y GROUP BY ALL")
def literal_affinity(spark, d):
    return rounded(affinity.subspace_affinity(spark, _frozen(spark, d)[1]).select("i", "j", "affinity"))


SPLIT = f"""w AS (SELECT *, n / sum(n) OVER () AS w FROM lit), g AS (SELECT dim, sum(w * m) AS g FROM lm JOIN w USING (cluster) GROUP BY dim), b AS (SELECT cluster, sum((m - g) * (m - g)) AS a FROM lm JOIN g USING (dim) GROUP BY cluster),
parts AS (SELECT sum(w * a) AS between_, sum(w * trace) AS within, sum(w * captured) AS captured FROM w JOIN b USING (cluster))"""


@query(f"""WITH {LIT}, {SPLIT} SELECT round(between_, 6) AS "between", round(within, 6) AS within, round(between_ + within, 6) AS total, round(captured, 6) AS captured, round(within - captured, 6) AS residual,
round(between_ / (between_ + within), 6) AS between_share, round(captured / (between_ + within), 6) AS captured_share, round((within - captured) / (between_ + within), 6) AS residual_share FROM parts""")
def literal_variance(spark, d):
    return rounded(variance.decomposition(_model(spark, d)[1]))


@query(f"WITH {LIT} SELECT round(sum(n * captured / greatest(trace, 1e-12)) / sum(n), 6) AS evr FROM lit")
def literal_evr(spark, d):
    return rounded(variance.weighted_evr(_model(spark, d)[1]))


LIT80 = f"{LIT}, cum AS (SELECT cluster, sum(e) OVER (PARTITION BY cluster ORDER BY e DESC, axis ROWS UNBOUNDED PRECEDING) / greatest(sum(e) OVER (PARTITION BY cluster), 1e-12) AS f FROM eig), dims AS (SELECT cluster, CAST(count(*) FILTER (f < 0.8) + 1 AS BIGINT) AS d80 FROM cum GROUP BY cluster)"


@query(f"WITH {LIT80} SELECT cluster, d80 FROM dims")
def literal_d80(spark, d):
    return variance.effective_dims(_model(spark, d)[1])


@query(f"WITH {LIT80} SELECT min(d80) AS least, quantile_disc(d80, 0.5) AS median, max(d80) AS most FROM dims")
def literal_d80_summary(spark, d):
    return variance.dims_summary(variance.effective_dims(_model(spark, d)[1])).withColumn("median", F.col("median").cast("long"))


@query(f"""WITH {lit_sql(where='file_id % 2 = 0')}, {judged_sql('file_id % 2 = 1')}, {SPLIT}, held AS (SELECT count(*) AS n, sum(greatest(r, 0)) AS residual, sum(greatest(w, 0)) AS within, sum(greatest(w - greatest(r, 0), 0)) AS captured FROM best),
total AS (SELECT sum((v - g) * (v - g)) AS total FROM long JOIN g USING (dim) WHERE file_id % 2 = 1), shares AS (SELECT residual / total AS held_out, (parts.within - parts.captured) / (between_ + parts.within) AS in_sample FROM held, total, parts)
SELECT n, round(residual, 6) AS residual, round(within, 6) AS within, round(captured, 6) AS captured, round(held_out, 6) AS held_out, round(in_sample, 6) AS in_sample, round(held_out - in_sample, 6) AS gap,
CASE WHEN held_out - in_sample > 0.03 THEN 'overfit' ELSE 'generalizes' END AS verdict FROM held, shares""")
def literal_holdout(spark, d):
    """The model of the even files on the odd ones."""
    tokens = X.tokens(spark, d)
    rows = literal_model(spark, tokens.where("file_id % 2 = 0"))
    found = holdout.evaluate(tokens.where("file_id % 2 = 1"), subspaces.model_from(rows), rows)
    return rounded(found.select("n", "residual", "within", "captured", "held_out", "in_sample", "gap", "verdict"))


CHOSEN = "chosen AS (SELECT file_id FROM (SELECT DISTINCT file_id FROM tokens WHERE file_id % 2 = 1) ORDER BY md5(concat_ws('|', file_id, 8)), file_id LIMIT 3)"


@query(f"""WITH {lit_sql(where='file_id % 2 = 0')}, {CHOSEN}, {judged_sql('file_id IN (SELECT file_id FROM chosen)')}, {SPLIT},
held AS (SELECT count(*) AS n, sum(greatest(r, 0)) AS residual, sum(greatest(w, 0)) AS within, sum(greatest(w - greatest(r, 0), 0)) AS captured FROM best),
total AS (SELECT sum((v - g) * (v - g)) AS total FROM long JOIN g USING (dim) WHERE file_id IN (SELECT file_id FROM chosen))
SELECT CAST(3 AS INTEGER) AS files, n AS tokens, round(total / n, 6) AS total, round(residual / n, 6) AS residual, round(held.within / n, 6) AS within, round(held.captured / n, 6) AS captured, round(residual / total, 6) AS residual_frac, round(1 - residual / total, 6) AS modeled_frac,
round(between_ + parts.within, 6) AS in_total, round(parts.within - parts.captured, 6) AS in_residual, round((parts.within - parts.captured) / (between_ + parts.within), 6) AS in_residual_frac, CAST(2.5 AS DOUBLE) AS final_obj_per_token FROM held, total, parts""")
def holdout_document(spark, d):
    """A run folder of the even files, its hold-out evaluation on three others, and the document as read back."""
    place = f"{store.shared_folder(spark)}/holdout-{uuid.uuid4().hex}"
    tokens = X.tokens(spark, d)
    load.write_token_table(tokens, f"{place}/tokens")
    rows = literal_model(spark, tokens.where("file_id % 2 = 0")).withColumn("radius", F.lit(None).cast("double"))
    even = tokens.where("file_id % 2 = 0").agg(F.sort_array(F.collect_set("file_id")).alias("files"))
    config = F.create_map(*[F.lit(x) for x in ("method", "subspace_kmeans", "src", f"{place}/tokens")])
    run = even.select(F.lit("even").alias("fingerprint"), config.alias("config"), "files", F.lit(None).cast("double").alias("final_obj_per_token"))
    history = spark.createDataFrame([(1, 3.5, 1.0, 1, 1, 1), (2, 2.5, 0.0, 1, 1, 1)], HISTORY)  # no final objective: the last of the history counts
    store.save_model(rows, run, history, f"{place}/run/model")
    programs.holdout_run(spark, HoldoutConfig(f"{place}/run", num_files=3, seed=8))
    found = store.load_holdout(spark, f"{place}/run/holdout.json")
    names = {f"in_sample.{c}": n for c, n in (("total", "in_total"), ("residual", "in_residual"), ("residual_frac", "in_residual_frac"), ("final_obj_per_token", "final_obj_per_token"))}
    return rounded(found.select(F.col("num_holdout_files").alias("files"), F.col("num_holdout_tokens").alias("tokens"), "holdout.*", *[F.col(c).alias(n) for c, n in names.items()]))


# --- re-seeding: clusters by the sizes of all tokens, the least size by the settings

SEEDS = f"""{lit_sql(f'm + CASE WHEN cluster >= {FAR} AND dim = 0 THEN 1.0 ELSE 0.0 END')}, {JUDGED}, sizes AS (SELECT lit.cluster, count(best.cluster) AS n FROM lit LEFT JOIN best USING (cluster) GROUP BY lit.cluster),
tiny AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS rank FROM sizes WHERE n < {CONFIG.least}), donors AS (SELECT cluster AS donor, row_number() OVER (ORDER BY n DESC, cluster) AS rank FROM sizes WHERE n >= {2 * CONFIG.least}),
plan AS (SELECT sizes.cluster, n, n < {CONFIG.least} AS tiny, donor FROM sizes LEFT JOIN (SELECT cluster, donor FROM tiny JOIN donors USING (rank)) t ON t.cluster = sizes.cluster)"""


def _plan(spark, d):
    tokens = X.tokens(spark, d)
    rows = literal_model(spark, tokens, far=True)
    found = subspaces.moments(tokens, subspaces.model_from(rows), None, False).select("cluster", "n")
    sizes = rows.select("cluster").join(found, "cluster", "left").na.fill(0, ["n"])
    return rows, subspaces.reseed_plan(sizes, CONFIG)


@query(f"WITH {SEEDS} SELECT cluster, n, tiny, donor FROM plan")
def literal_reseeding(spark, d):
    return _plan(spark, d)[1]


@query(f"""WITH {SEEDS}, first AS (SELECT cluster, axis, e FROM eig QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY e DESC, axis) = 1),
sides AS (SELECT cluster, donor, -1.0 AS s FROM plan WHERE tiny AND donor IS NOT NULL UNION ALL SELECT donor, donor, 1.0 FROM plan WHERE tiny AND donor IS NOT NULL)
SELECT sides.cluster, donor AS source, had.dim, round(m + s * sqrt(e) * u, 6) AS m FROM sides JOIN first ON first.cluster = donor JOIN had ON had.cluster = donor AND had.axis = first.axis JOIN base ON base.cluster = donor AND base.dim = had.dim""")
def literal_split(spark, d):
    """The means of both sides of every split."""
    rows, plan = _plan(spark, d)
    return rounded(subspaces.split_rows(rows, plan).select("cluster", "source", F.posexplode("mean").alias("dim", "m")))


# --- the given tables by operators whose older queries read none

@query(f"WITH {NEST}, {DOMINANT} SELECT cell_id, CAST(ring_id AS BIGINT) AS ring_id, round((lon + 540) % 360 - 180, 6) AS lon, round(degrees(asin(z)), 6) AS lat, round((lon + 360) % 360, 6) AS ring_lon, label FROM dom JOIN q ON p = cell_id")
def dominant_places(spark, d):
    """Where the dominant clusters are: nested cells by ring, longitude and latitude, and the ring's own longitude."""
    best = spatial.dominant(spatial.cell_cluster_counts(X.assignments(spark, d)))
    placed = best.select("cell_id", "label").join(F.broadcast(healpix.cells(spark, NSIDE)), "cell_id", "left")  # 12 nside^2 rows
    rings = F.broadcast(spark.range(CELLS).select(F.col("id").alias("ring_id"), healpix.ring_lonlat(F.col("id"), NSIDE)[0].alias("ring_lon")))  # 12 nside^2 rows
    return rounded(placed.join(rings, "ring_id", "left").select("cell_id", "ring_id", "lon", "lat", "ring_lon", "label"))


@query(f"""WITH {ASSIGN} SELECT file_id, TIMESTAMP '2014-01-01' + to_hours(CAST(file_id * 6 AS BIGINT)) AS ts, CAST(month(TIMESTAMP '2014-01-01' + to_hours(CAST(file_id * 6 AS BIGINT))) AS INTEGER) AS month, CAST(CAST(file_id AS BIGINT) * 10 // 13021 AS INTEGER) AS decile, count(*) AS n FROM assign GROUP BY file_id""")
def file_times(spark, d):
    file = F.col("file_id")
    counted = X.assignments(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("file_id", calendar.timestamp_of(file).alias("ts"), calendar.month_of(file).alias("month"), calendar.decile_of(file, 13021).alias("decile"), "n")


RUNS = {"a": 7, "b": 8, "c": 7}
_one = lambda name, seed: f"SELECT '{name}' AS name, substr(sha1('192|' || string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id)), 1, 12) AS fingerprint FROM (SELECT file_id FROM (SELECT DISTINCT file_id FROM assign) ORDER BY md5(concat_ws('|', file_id, {seed})), file_id LIMIT 100)"


@query(f"WITH {ASSIGN} SELECT fingerprint, count(*) AS runs, string_agg(name, ',' ORDER BY name) AS names FROM ({' UNION ALL '.join(f'({_one(n, s)})' for n, s in RUNS.items())}) GROUP BY fingerprint")
def runs_by_sample(spark, d):
    """Which runs have drawn the same files."""
    runs = [sampling.fingerprint(sampling.sample_files(X.assignments(spark, d), 100, seed), CELLS, None).select(F.lit(name).alias("name"), "fingerprint") for name, seed in RUNS.items()]
    return compare.comparable_runs(reduce(DataFrame.union, runs))


CORNER = lambda n, dx, dy: f"""[2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4][face + 1] * 4 - x - {dx} - y - {dy} AS c{n}, least(c{n}, 4, 16 - c{n}) AS k{n},
  c{n} * 1000 + CASE WHEN k{n} > 0 THEN (([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7][face + 1] * k{n} + x + {dx} - y - {dy}) + 8 * k{n}) % (8 * k{n}) ELSE 0 END AS p{n}"""  # noqa: E731


@query(f"""WITH {NEST}, {DOMINANT}, corners AS (SELECT p, {CORNER(0, 0, 0)}, {CORNER(1, 1, 0)}, {CORNER(2, 1, 1)}, {CORNER(3, 0, 1)} FROM q),
sides AS (SELECT p, unnest([[least(p0, p1), greatest(p0, p1)], [least(p1, p2), greatest(p1, p2)], [least(p2, p3), greatest(p2, p3)], [least(p3, p0), greatest(p3, p0)]]) AS side FROM corners),
e AS (SELECT DISTINCT min(p) AS a, max(p) AS b FROM sides GROUP BY side HAVING min(p) < max(p))
SELECT count(*) AS pairs, count(*) FILTER (a // 16 <> b // 16) AS across, round(avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END), 6) AS agreement, round({K} * avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END), 6) AS times_chance
FROM e JOIN dom x ON x.cell_id = e.a JOIN dom y ON y.cell_id = e.b""")
def edge_agreement(spark, d):
    """Neighbours over all edges, those between base faces included."""
    best = spatial.dominant(spatial.cell_cluster_counts(X.assignments(spark, d)))
    edges = healpix.edges(spark, NSIDE)
    inside = best.select(F.col("cell_id").alias("a")).join(edges, "a").join(best.select(F.col("cell_id").alias("b")), "b")
    face = lambda c: F.floor(F.col(c) / (NSIDE * NSIDE))
    across = inside.agg(F.count_if(face("a") != face("b")).alias("across"))
    return rounded(compare.neighbour_agreement(best, edges, K).crossJoin(across))  # one row each


# --- comparison of runs: three labellings of the same tokens

LABELLINGS = ("label", "other", "third")
THREE = f"{ASSIGN}, three AS (SELECT *, (label * 3 + other + cell_id % 2) % 5 AS third FROM assign)"
_pair = lambda x, y: f"SELECT '{x}' AS run_a, '{y}' AS run_b, {x} AS a, {y} AS b, count(*) AS n FROM three GROUP BY ALL"
PAIRED = f"""{THREE}, pairs AS ({' UNION ALL '.join(_pair(x, y) for i, x in enumerate(LABELLINGS) for y in LABELLINGS[i + 1 :])}),
sa AS (SELECT run_a, run_b, a, sum(n) AS m FROM pairs GROUP BY ALL), sb AS (SELECT run_a, run_b, b, sum(n) AS m FROM pairs GROUP BY ALL), st AS (SELECT run_a, run_b, sum(n) AS s FROM pairs GROUP BY ALL)"""


def _three(spark, d):
    rows = X.assignments(spark, d)
    return rows.withColumn("third", (F.col("label") * 3 + F.col("other") + F.col("cell_id") % 2) % 5)


@query(f"WITH {PAIRED} SELECT run_a, run_b, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, n FROM pairs")
def run_label_pairs(spark, d):
    return compare.run_pairs(_three(spark, d), [*LABELLINGS])


@query(f"""WITH {PAIRED}, mi AS (SELECT run_a, run_b, sum(n / s * ln(n * s / (sa.m * sb.m))) AS mi FROM pairs JOIN sa USING (run_a, run_b, a) JOIN sb USING (run_a, run_b, b) JOIN st USING (run_a, run_b) GROUP BY ALL),
ea AS (SELECT run_a, run_b, -sum(m / s * ln(m / s)) AS h, sum(m * (m - 1) / 2) AS c FROM sa JOIN st USING (run_a, run_b) GROUP BY ALL), eb AS (SELECT run_a, run_b, -sum(m / s * ln(m / s)) AS h, sum(m * (m - 1) / 2) AS c FROM sb JOIN st USING (run_a, run_b) GROUP BY ALL),
ab AS (SELECT run_a, run_b, sum(n * (n - 1) / 2) AS c FROM pairs GROUP BY ALL)
SELECT run_a, run_b, CAST(s AS BIGINT) AS tokens, round(mi / ((ea.h + eb.h) / 2), 6) AS nmi, round((ab.c - ea.c * eb.c / (s * (s - 1) / 2)) / ((ea.c + eb.c) / 2 - ea.c * eb.c / (s * (s - 1) / 2)), 6) AS ari
FROM mi JOIN ea USING (run_a, run_b) JOIN eb USING (run_a, run_b) JOIN ab USING (run_a, run_b) JOIN st USING (run_a, run_b)""")
def run_agreement(spark, d):
    return rounded(compare.agreements(compare.run_pairs(_three(spark, d), [*LABELLINGS])))


@query()
def kcenter_coreset(spark, d):
    """Centres from core-sets: (cluster, n, radius); no SQL, as the core-sets follow the partitions of the table."""
    tokens = X.tokens(spark, d)
    model, _ = subspaces.core_centres(tokens, 5)
    rows = subspaces.assigned(tokens, model)
    return rows.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.greatest("within", F.lit(0.0)))).alias("radius"))


# --- maps: the grid behind an image

STEP, SIGMA = 10.0, 0.9
_WEIGHTS = ", ".join(f"({o}, {w!r})" for o, w in grid.gauss(SIGMA).items())
_LAT = lambda r: f"degrees(asin(CASE WHEN {r} < 4 THEN 1 - {r} * {r} / 48.0 WHEN {r} > 12 THEN (16 - {r}) * (16 - {r}) / 48.0 - 1 ELSE (8 - {r}) * 2 / 12.0 END))"
GRID_SQL = f"""{NEST}, {DOMINANT}, cells AS (SELECT CAST(ring_id AS BIGINT) AS ring_id, label / 7.0 AS r, 1 - label / 7.0 AS g, (label % 3) / 2.0 AS b FROM q JOIN dom ON p = cell_id),
pts AS (SELECT CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, 85.0 - 10 * i AS lat, (-175 + 10 * j + 360) % 360 AS lon, sin(radians(85.0 - 10 * i)) AS z FROM range(18) a(i), range(36) c(j)),
rr AS (SELECT *, CAST(ceil(CASE WHEN z > 2 / 3.0 THEN 4 * sqrt(3 * (1 - z)) WHEN z < -2 / 3.0 THEN 16 - 4 * sqrt(3 * (1 + z)) ELSE 8 - 6 * z END - 1e-9) AS BIGINT) AS below FROM pts),
rings AS (SELECT y, x, lon, greatest(1, least(15, below)) AS ring, 1.0 AS w FROM rr WHERE below <= 1 OR below > 15
  UNION ALL SELECT y, x, lon, below - 1, 1 - ({_LAT('(below - 1)')} - lat) / ({_LAT('(below - 1)')} - {_LAT('below')}) FROM rr WHERE below BETWEEN 2 AND 15
  UNION ALL SELECT y, x, lon, below, ({_LAT('(below - 1)')} - lat) / ({_LAT('(below - 1)')} - {_LAT('below')}) FROM rr WHERE below BETWEEN 2 AND 15),
at_ AS (SELECT y, x, w, least(ring, 4, 16 - ring) AS k, CASE WHEN ring < 4 THEN 2 * ring * (ring - 1) WHEN ring > 12 THEN 192 - 2 * k * (k + 1) ELSE 24 + (ring - 4) * 16 END AS first_,
  lon * k / 90.0 - CASE WHEN ring < 4 OR ring > 12 OR (ring - 4) % 2 = 0 THEN 0.5 ELSE 0 END AS pos FROM rings),
spot AS (SELECT y, x, CAST(first_ + (floor(pos) + 4 * k) % (4 * k) AS BIGINT) AS ring_id, w * (1 - (pos - floor(pos))) AS w FROM at_ UNION ALL SELECT y, x, CAST(first_ + (floor(pos) + 1 + 4 * k) % (4 * k) AS BIGINT), w * (pos - floor(pos)) FROM at_),
field AS (SELECT y, x, sum(w * r) AS r, sum(w * g) AS g, sum(w * b) AS b FROM spot JOIN cells USING (ring_id) GROUP BY y, x),
weights(o, w) AS (VALUES {_WEIGHTS}),
across AS (SELECT f.y, f.x, sum(w * s.r) AS r, sum(w * s.g) AS g, sum(w * s.b) AS b FROM field f, weights, field s WHERE s.y = f.y AND s.x = (f.x + o + 36) % 36 GROUP BY f.y, f.x),
down AS (SELECT f.y, f.x, sum(w * s.r) AS r, sum(w * s.g) AS g, sum(w * s.b) AS b FROM across f, weights, across s WHERE s.x = f.x AND s.y = greatest(0, least(17, f.y + o)) GROUP BY f.y, f.x)"""


@query(f"WITH {GRID_SQL} SELECT y AS row, x AS col, round(greatest(0, least(1, r)), 6) AS r, round(greatest(0, least(1, g)), 6) AS g, round(greatest(0, least(1, b)), 6) AS b FROM down")
def map_grid(spark, d):
    """Dominant clusters as colours on a grid of ten degrees, interpolated and smoothed."""
    return rounded(_grid(spark, d))


@query(f"WITH {GRID_SQL}, eight AS (SELECT y, x, CAST(round(greatest(0, least(1, r)) * 255) * 65536 + round(greatest(0, least(1, g)) * 255) * 256 + round(greatest(0, least(1, b)) * 255) AS BIGINT) AS colour FROM down) SELECT y AS row, x AS col, colour, CAST(dense_rank() OVER (ORDER BY colour) - 1 AS INTEGER) AS number FROM eight")
def map_palette(spark, d):
    return grid.palette(_grid(spark, d)).select("row", "col", "colour", "number")


def _grid(spark, d):
    best = spatial.dominant(spatial.cell_cluster_counts(X.assignments(spark, d)))
    label = F.col("id").cast("int")
    colours = spark.range(K).select(label.alias("label"), (label / 7.0).alias("r"), (1 - label / 7.0).alias("g"), ((label % 3) / 2.0).alias("b"))
    return grid.smoothed(grid.interpolated(grid.cell_colours(best, colours, NSIDE), NSIDE, STEP), STEP, SIGMA)
