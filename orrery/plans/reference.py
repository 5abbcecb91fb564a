"""Registered queries of the clustering operators, with DuckDB SQL where there is one.

Computed doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import calendar, healpix
from orrery.functions.vectors import squared_norm as norm_of
from orrery.operators import affinity, compare, holdout, sampling, spatial, subspaces, temporal, variance, vectors
from orrery.sources import fixtures as X
from orrery.sources import load, store
from orrery.sources.schema import FitConfig, LoadConfig

K, CELLS, FILES, NSIDE = X.CLUSTERS, X.CELLS, 13021, X.NSIDE
TOKEN_K = X.TOKEN_CLUSTERS
ASSIGN, TOKENS = X.ASSIGN_SQL, X.TOKENS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select([F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _assign(spark, d):
    return X.assignments(spark, d)


def _months(spark, d):
    return temporal.cube(_assign(spark, d))


def _point_model(spark, d):
    """Centroids of the labelled tokens as a model of dimension 0, with traces."""
    tokens = X.tokens(spark, d)
    sq = tokens.groupBy(F.col("label").alias("cluster")).agg(F.avg(vectors.squared_norm(F.col("features"))).alias("sq"))
    rows = vectors.centroids(tokens).join(sq, "cluster")
    trace = F.col("sq") - vectors.squared_norm(F.col("mean"))
    return rows.select("cluster", "n", "mean", trace.alias("trace"), F.array().cast("array<double>").alias("eigvals"))


# --- assignments

LABELS = "labels_ AS (SELECT CAST(range AS INTEGER) AS label FROM range(8))"
COUNTS = f"{ASSIGN}, counts AS (SELECT cell_id, label, count(*) AS n FROM assign GROUP BY ALL)"
DOMINANT = f"{COUNTS}, dom AS (SELECT cell_id, label, n FROM counts QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, label) = 1)"


@query(f"WITH {COUNTS} SELECT cell_id, label, n FROM counts")
def cell_cluster_counts(spark, d):
    return spatial.cell_cluster_counts(_assign(spark, d))


@query(f"WITH {ASSIGN} SELECT DISTINCT cell_id FROM assign")
def cells_with_data(spark, d):
    return spatial.cells_with_data(_assign(spark, d))


@query(f"WITH {DOMINANT} SELECT cell_id, label, n FROM dom")
def dominant_cluster(spark, d):
    return spatial.dominant(spatial.cell_cluster_counts(_assign(spark, d)))


@query(f"WITH {DOMINANT}, {LABELS} SELECT label, count(cell_id) AS owned FROM labels_ LEFT JOIN dom USING (label) GROUP BY label")
def owned_cells(spark, d):
    return spatial.owned_cells(_assign(spark, d), K)


@query(f"""WITH {COUNTS}, {LABELS}, run AS (
  SELECT label, sum(n) OVER (PARTITION BY label ORDER BY n DESC, cell_id ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY label) AS total FROM counts),
h AS (SELECT label, CAST(count(*) FILTER (2 * cum < total) + 1 AS BIGINT) AS c FROM run GROUP BY label)
SELECT label, coalesce(c, 193) AS cells50 FROM labels_ LEFT JOIN h USING (label)""")
def cells_at_50(spark, d):
    return spatial.cells_at_half(_assign(spark, d), K, CELLS)


@query(f"""WITH {ASSIGN}, {LABELS}, f AS (SELECT label, count(DISTINCT file_id) AS files FROM assign GROUP BY label)
SELECT label, coalesce(files, 0) AS files, round(coalesce(files, 0) / (SELECT count(DISTINCT file_id) FROM assign), 6) AS share FROM labels_ LEFT JOIN f USING (label)""")
def file_presence(spark, d):
    return rounded(spatial.file_presence(_assign(spark, d), K))


DECILES = f"{ASSIGN}, {LABELS}, bucket AS (SELECT CAST(CAST(file_id AS BIGINT) * 10 // 13021 AS INTEGER) AS b, label, count(*) AS n FROM assign GROUP BY ALL)"
MONTH = "CAST(month(TIMESTAMP '2014-01-01' + to_hours(CAST(file_id * 6 AS BIGINT))) AS INTEGER)"
MONTHS = f"{ASSIGN}, {LABELS}, cube AS (SELECT {MONTH} AS month, cell_id, label, count(*) AS n FROM assign GROUP BY ALL), bucket AS (SELECT month AS b, label, CAST(sum(n) AS BIGINT) AS n FROM cube GROUP BY ALL)"
GRID = """per_b AS (SELECT b, sum(n) AS bn FROM bucket GROUP BY b), per_l AS (SELECT label, coalesce(sum(n), 0) AS ln FROM labels_ LEFT JOIN bucket USING (label) GROUP BY label),
grid AS (SELECT b, label, CAST(coalesce(n, 0) AS BIGINT) AS n, (coalesce(n, 0) / greatest(ln, 1)) / greatest(bn / (SELECT sum(n) FROM bucket), 1e-12) AS e
         FROM per_b CROSS JOIN per_l LEFT JOIN bucket USING (b, label)),
cv AS (SELECT label, stddev_pop(e) / greatest(avg(e), 1e-12) AS cv FROM grid GROUP BY label)"""
MONTHLY = f"{MONTHS}, mdom AS (SELECT month, cell_id, label, n FROM cube QUALIFY row_number() OVER (PARTITION BY month, cell_id ORDER BY n DESC, label) = 1)"


@query(f"WITH {DECILES} SELECT b AS decile, label, n, CAST(sum(n) OVER (PARTITION BY b) AS BIGINT) AS decile_total FROM bucket")
def decile_counts(spark, d):
    return spatial.decile_counts(_assign(spark, d), FILES)


def _deciles(spark, d):
    return spatial.bucket_counts(_assign(spark, d), calendar.decile_of(F.col("file_id"), FILES), "decile")


@query(f"WITH {DECILES}, {GRID} SELECT b AS decile, label, n, round(e, 6) AS enrichment FROM grid")
def decile_enrichment(spark, d):
    return rounded(spatial.enrichment(_deciles(spark, d), "decile", K))


@query(f"WITH {DECILES}, {GRID} SELECT label, round(cv, 6) AS cv FROM cv")
def temporal_cv(spark, d):
    return rounded(spatial.variation(spatial.enrichment(_deciles(spark, d), "decile", K)))


@query(f"WITH {DECILES}, {GRID}, best AS (SELECT label, cv FROM cv ORDER BY round(cv, 9) DESC, label LIMIT 8) SELECT label, round(cv, 6) AS cv, "
       + ", ".join(f"round(max(e) FILTER (b = {i}), 6) AS d{i}" for i in range(10)) + " FROM best JOIN grid USING (label) GROUP BY label, cv")
def decile_profile(spark, d):
    return rounded(spatial.decile_profile(_assign(spark, d), FILES, K))


# --- calendar


@query(f"SELECT CAST(range AS INTEGER) AS file_id, TIMESTAMP '2014-01-01' + to_hours(CAST(range * 6 AS BIGINT)) AS ts, {MONTH.replace('file_id', 'range')} AS month, CAST(range * 10 // 13021 AS INTEGER) AS decile FROM range(13021)")
def time_axis(spark, d):
    return calendar.time_axis(spark, FILES)


@query(f"WITH {MONTHS} SELECT month, cell_id, label, n FROM cube")
def month_cell_cluster(spark, d):
    return _months(spark, d)


@query(f"WITH {MONTHLY} SELECT month, cell_id, label, n FROM mdom")
def monthly_dominant(spark, d):
    return temporal.monthly_dominant(_months(spark, d))


@query(f"WITH {DOMINANT} SELECT cell_id, label, n FROM dom")
def annual_dominant(spark, d):
    return temporal.annual_dominant(_months(spark, d))


@query(f"WITH {MONTHS} SELECT coalesce(b, -1) AS month, coalesce(label, -1) AS label, CAST(sum(n) AS BIGINT) AS n FROM bucket GROUP BY ROLLUP (b, label)")
def month_rollup(spark, d):
    return temporal.month_rollup(_months(spark, d)).na.fill(-1, ["month", "label"])  # -1: all


@query(f"WITH {ASSIGN}, f AS (SELECT DISTINCT file_id, {MONTH} AS month FROM assign) SELECT CAST(range AS INTEGER) AS month, count(file_id) AS files FROM range(1, 13) LEFT JOIN f ON month = range GROUP BY range")
def files_per_month(spark, d):
    return temporal.files_per_month(_assign(spark, d))


@query(f"WITH {MONTHS}, {GRID} SELECT b AS month, label, n, round(e, 6) AS enrichment FROM grid")
def monthly_enrichment(spark, d):
    return rounded(temporal.monthly_enrichment(_months(spark, d), K))


@query(f"WITH {MONTHS}, {GRID} SELECT label, " + ", ".join(f"round(max(e) FILTER (b = {m}), 6) AS m{m}" for m in range(1, 13)) + " FROM grid GROUP BY label")
def monthly_profile(spark, d):
    return rounded(temporal.monthly_profile(_months(spark, d), K))


@query(f"WITH {MONTHS}, {GRID} SELECT label, round(cv, 6) AS seasonality FROM cv")
def seasonality(spark, d):
    return rounded(temporal.seasonality(_months(spark, d), K))


@query(f"WITH {MONTHS}, {GRID} SELECT label, round(cv, 6) AS seasonality FROM cv ORDER BY round(cv, 9) DESC, label LIMIT 8")
def top_seasonal(spark, d):
    return rounded(temporal.top_seasonal(_months(spark, d), K))


FLIPS = f"""{MONTHLY}, pair AS (SELECT a.month, count(*) AS both_, count(*) FILTER (a.label <> b.label) AS flips FROM mdom a JOIN mdom b ON a.cell_id = b.cell_id AND b.month = a.month + 1 GROUP BY a.month),
flip AS (SELECT CAST(range AS INTEGER) AS month, coalesce(both_, 0) AS both_, coalesce(flips, 0) AS flips, flips / both_ AS rate FROM range(1, 12) LEFT JOIN pair ON month = range)"""


@query(f'WITH {FLIPS} SELECT month, both_ AS "both", flips, round(rate, 6) AS rate FROM flip')
def month_flip_rate(spark, d):
    return rounded(temporal.flip_rates(_months(spark, d)))


@query(f"WITH {FLIPS} SELECT round(min(rate), 6) AS least, round(avg(rate), 6) AS mean, round(max(rate), 6) AS most FROM flip")
def month_flip_summary(spark, d):
    return rounded(temporal.flip_summary(_months(spark, d)))


@query(f"""WITH {MONTHLY}, j AS (SELECT a.label AS x, b.label AS y FROM mdom a JOIN mdom b USING (cell_id) WHERE a.month = 1 AND b.month = 7)
SELECT count(*) AS "both", count(*) FILTER (x <> y) AS flips, round(count(*) FILTER (x <> y) / nullif(count(*), 0), 6) AS rate FROM j""")
def jan_jul_shift(spark, d):
    return rounded(temporal.shift(_months(spark, d)))


@query(f"""WITH {MONTHLY}, o AS (SELECT label, count(*) FILTER (month = 1) AS before, count(*) FILTER (month = 7) AS after FROM mdom GROUP BY label)
SELECT label, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta FROM labels_ LEFT JOIN o USING (label) ORDER BY delta DESC, label LIMIT 5""")
def owned_delta(spark, d):
    return temporal.owned_delta(_months(spark, d), K)


# --- geometry

_bits = lambda shift: " | ".join(f"((((p % 16) >> {2 * b + shift}) & 1) << {b})" for b in range(2))
NEST = f"""q AS (SELECT range AS p, p // 16 AS face, {_bits(0)} AS x, {_bits(1)} AS y, [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4][p // 16 + 1] * 4 - x - y - 1 AS ring,
  CASE WHEN ring < 4 THEN ring WHEN ring > 12 THEN 16 - ring ELSE 4 END AS nr, CASE WHEN ring < 4 OR ring > 12 THEN 0 ELSE (ring - 4) & 1 END AS shift,
  ([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7][p // 16 + 1] * nr + x - y + 1 + shift) // 2 AS j0, CASE WHEN j0 > 4 * nr THEN j0 - 4 * nr WHEN j0 < 1 THEN j0 + 4 * nr ELSE j0 END AS j,
  CASE WHEN ring < 4 THEN 2 * nr * (nr - 1) WHEN ring > 12 THEN 192 - 2 * (nr + 1) * nr ELSE 24 + (ring - 4) * 16 END + j - 1 AS ring_id,
  CASE WHEN ring < 4 THEN 1 - nr * nr / 48.0 WHEN ring > 12 THEN nr * nr / 48.0 - 1 ELSE (8 - ring) * 2 / 12.0 END AS z, (j - (shift + 1) * 0.5) * 90.0 / nr AS lon FROM range(192))"""


@query(f"WITH {NEST} SELECT p AS cell_id, CAST(ring_id AS BIGINT) AS ring_id FROM q")
def nest_to_ring(spark, d):
    return spark.range(CELLS).select(F.col("id").alias("cell_id"), healpix.nest_to_ring(F.col("id"), NSIDE).alias("ring_id"))


@query(f"WITH {NEST} SELECT CAST(ring_id AS BIGINT) AS ring_id, round((lon + 360) % 360, 6) AS lon, round(degrees(asin(z)), 6) AS lat FROM q")
def ring_lonlat(spark, d):
    lon, lat = healpix.ring_lonlat(F.col("id"), NSIDE)
    return rounded(spark.range(CELLS).select(F.col("id").alias("ring_id"), lon.alias("lon"), lat.alias("lat")))


@query(f"WITH {NEST} SELECT CAST(p AS INTEGER) AS cell_id, CAST(ring_id AS BIGINT) AS ring_id, round((lon + 540) % 360 - 180, 6) AS lon, round(degrees(asin(z)), 6) AS lat FROM q")
def cell_lonlat(spark, d):
    return rounded(healpix.cells(spark, NSIDE))


# --- sampling

FILE_KEY, CELL_KEY = "md5(concat_ws('|', file_id, 7))", "md5(concat_ws('|', file_id, cell_id, 7))"
SAMPLE = f"{ASSIGN}, sample AS (SELECT file_id FROM (SELECT DISTINCT file_id FROM assign) ORDER BY {FILE_KEY}, file_id LIMIT 100)"
POOL = f"{SAMPLE}, pool AS (SELECT file_id FROM (SELECT DISTINCT file_id FROM assign) WHERE file_id NOT IN (SELECT file_id FROM sample) ORDER BY md5(concat_ws('|', file_id, 8)), file_id LIMIT 50)"


def _sample(spark, d):
    return sampling.sample_files(_assign(spark, d), 100, 7)


@query(f"WITH {SAMPLE} SELECT file_id, CAST(row_number() OVER (ORDER BY {FILE_KEY}, file_id) AS INTEGER) AS rank FROM sample")
def file_sample(spark, d):
    return _sample(spark, d)


@query(f"WITH {SAMPLE} SELECT file_id, count(*) AS n FROM assign WHERE file_id IN (SELECT file_id FROM sample) GROUP BY file_id")
def file_reuse(spark, d):
    return sampling.reuse_files(_assign(spark, d), _sample(spark, d)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOKENS} SELECT file_id, cell_id FROM tokens QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {CELL_KEY}, cell_id) <= 5")
def cell_sample(spark, d):
    return sampling.sample_cells(X.tokens(spark, d).select("file_id", "cell_id"), 5, 7)


@query(f"WITH {SAMPLE} SELECT substr(sha1('12288|7|' || string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id)), 1, 12) AS fingerprint FROM sample")
def sample_fingerprint(spark, d):
    return sampling.fingerprint(_sample(spark, d), 12288, 7)


@query(f"WITH {SAMPLE} SELECT substr(sha1('12288|' || string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id)), 1, 12) AS fingerprint FROM sample")
def content_fingerprint(spark, d):
    return sampling.fingerprint(_sample(spark, d), 12288, None)


@query(f"""WITH {TOKENS}, picked AS (SELECT file_id, row_number() OVER (ORDER BY md5(concat_ws('|', file_id, 7)), file_id) - 1 AS rank FROM (SELECT DISTINCT file_id FROM tokens)),
six AS (SELECT * FROM picked WHERE rank < 6), named AS (SELECT substr(sha1('20|7|' || string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id)), 1, 12) AS fingerprint FROM six),
drawn AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {CELL_KEY}, cell_id) AS draw FROM tokens JOIN six USING (file_id))
SELECT file_id, cell_id, CAST(rank AS INTEGER) AS rank, fingerprint, round(list_sum(list_transform(features, lambda x: x * x)), 6) AS sq FROM drawn, named WHERE draw <= 20""")
def load_tokens(spark, d):
    """From a table written by file to the tokens of six sampled files, twenty of each."""
    place = f"{store.shared_folder(spark)}/load-{uuid.uuid4().hex}"
    load.write_token_table(X.tokens(spark, d), f"{place}/tokens")
    found = load.load_tokens(spark, f"{place}/tokens", LoadConfig(num_files=6, tokens_per_file=20, seed=7, dim=X.TOKEN_DIM), place)
    return rounded(found.tokens.select("file_id", "cell_id", "rank", "fingerprint", norm_of(F.col("features").cast("array<double>")).alias("sq")))


@query(f"WITH {TOKENS} SELECT count(*) AS n_tokens, count(*) * 64 * 2 AS bytes FROM tokens")
def ram_estimate(spark, d):
    return sampling.estimate_bytes(X.tokens(spark, d), X.TOKEN_DIM)


@query(f"WITH {POOL} SELECT file_id, CAST(row_number() OVER (ORDER BY md5(concat_ws('|', file_id, 8)), file_id) AS INTEGER) AS rank FROM pool")
def holdout_pool(spark, d):
    return sampling.holdout_pool(_assign(spark, d), _sample(spark, d), 50, 8)


# --- distances and the fit at dimension 0

DIST = f"""{TOKENS}, dist AS (SELECT token_id, label, cluster, sum(v * m) AS dot, sum((v - m) * (v - m)) AS residual FROM long JOIN means USING (dim) GROUP BY ALL),
best AS (SELECT token_id, label, cluster, residual FROM dist QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY residual, cluster) = 1)"""
TRACE = f"""{TOKENS}, sq AS (SELECT label AS cluster, sum(v * v) / count(DISTINCT token_id) AS sq FROM long GROUP BY label),
model AS (SELECT cluster, max(n) AS n, max(sq) - sum(m * m) AS trace FROM means JOIN sq USING (cluster) GROUP BY cluster),
w AS (SELECT cluster, n, trace, n / sum(n) OVER () AS w FROM model), g AS (SELECT dim, sum(w * m) AS g FROM means JOIN w USING (cluster) GROUP BY dim),
away AS (SELECT cluster, sum((m - g) * (m - g)) AS away FROM means JOIN g USING (dim) GROUP BY cluster),
parts AS (SELECT sum(w * away) AS between_, sum(w * trace) AS within FROM w JOIN away USING (cluster))"""
PAIRS = f"""{TOKENS}, pairs AS (SELECT a.cluster AS i, b.cluster AS j, sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS cosine
  FROM means a JOIN means b ON a.dim = b.dim AND a.cluster < b.cluster GROUP BY ALL)"""


def _distances(spark, d):
    tokens = X.tokens(spark, d)
    return vectors.against_centroids(tokens, vectors.centroids(tokens))


@query(f"WITH {TOKENS} SELECT token_id, round(sum(v * v), 6) AS sq FROM long GROUP BY token_id")
def squared_norm(spark, d):
    return rounded(vectors.squared_norms(X.tokens(spark, d)))


@query(f"WITH {DIST} SELECT token_id, cluster, round(dot, 6) AS dot FROM dist")
def centroid_dot(spark, d):
    return rounded(_distances(spark, d).select("token_id", "cluster", "dot"))


@query(f"WITH {DIST} SELECT token_id, cluster, round(residual, 6) AS residual FROM dist")
def point_residual(spark, d):
    return rounded(_distances(spark, d).select("token_id", "cluster", "residual"))


@query(f"WITH {DIST} SELECT token_id, cluster, round(residual, 6) AS residual FROM best")
def nearest_centroid(spark, d):
    return rounded(vectors.nearest(_distances(spark, d)).select("token_id", "cluster", "residual"))


@query(f"WITH {DIST} SELECT count(*) AS n, round(sum(greatest(residual, 0)), 6) AS objective, round(avg(greatest(residual, 0)), 6) AS per_token FROM best")
def objective(spark, d):
    return rounded(vectors.objective(vectors.nearest(_distances(spark, d))))


@query(f"WITH {DIST} SELECT count(*) FILTER (label <> cluster) AS changed, round(avg(CASE WHEN label <> cluster THEN 1.0 ELSE 0.0 END), 6) AS frac_changed FROM best")
def labels_changed(spark, d):
    return rounded(vectors.labels_changed(vectors.nearest(_distances(spark, d))))


@query(f"WITH {PAIRS} SELECT i, j, round(cosine, 6) AS cosine FROM pairs")
def centroid_cosine(spark, d):
    return rounded(affinity.centroid_cosines(_point_model(spark, d)))


@query(f"WITH {TOKENS}, n AS (SELECT token_id, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM long GROUP BY token_id) SELECT token_id, dim, round(v / n, 6) AS v FROM long JOIN n USING (token_id)")
def unit_vector(spark, d):
    return rounded(vectors.unit_vectors(X.tokens(spark, d)).select("token_id", F.posexplode("features").alias("dim", "v")))


@query(f"WITH {TOKENS} SELECT token_id FROM tokens ORDER BY {CELL_KEY}, file_id, cell_id LIMIT 10")
def init_seeds(spark, d):
    return subspaces.seeds(X.tokens(spark, d), TOKEN_K, 7).select("token_id")


@query(f"WITH {TOKENS} SELECT CAST(label AS INTEGER) AS cluster, dim, count(*) AS n, round(sum(v), 6) AS sum_x FROM long GROUP BY label, dim")
def cluster_moments(spark, d):
    long = X.tokens(spark, d).select(F.col("label").cast("int").alias("cluster"), F.posexplode("features").alias("dim", "v"))
    return rounded(long.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum_x")))


@query(f"""WITH {DIST} SELECT CAST(cluster AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(features[i] * features[j]), 6) AS value
FROM best JOIN tokens USING (token_id), (SELECT unnest(range(1, 65)) AS i) x, (SELECT unnest(range(1, 65)) AS j) y WHERE i <= j GROUP BY ALL""")
def second_moments(spark, d):
    """Under the centroids of the labels, as the sweep of a fit assigns and sums them."""
    model = subspaces.model_from(_point_model(spark, d).withColumns({"basis": F.array().cast("array<array<double>>"), "reseeded": F.lit(False)}))
    return rounded(subspaces.second_moments(X.tokens(spark, d), model))


@query(f"WITH {TRACE} SELECT CAST(cluster AS INTEGER) AS cluster, n, round(trace, 6) AS trace FROM model")
def mean_trace_update(spark, d):
    return rounded(_point_model(spark, d).select("cluster", "n", "trace"))


SIZES = f"{ASSIGN}, sizes AS (SELECT label AS cluster, count(*) AS n FROM assign WHERE file_id % 8 < label + 1 GROUP BY label)"


def _sizes(spark, d):
    return _assign(spark, d).where("file_id % 8 < label + 1").groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SIZES}, t AS (SELECT median(n) / 2 AS least FROM sizes) SELECT cluster, n FROM sizes, t WHERE n < least")
def tiny_clusters(spark, d):
    sizes = _sizes(spark, d)
    return sizes.crossJoin(sizes.agg((F.median("n") / 2).alias("least"))).where(F.col("n") < F.col("least")).select("cluster", "n")


@query(f"WITH {SIZES}, t AS (SELECT min(n) AS least FROM sizes) SELECT cluster, n, CAST(row_number() OVER (ORDER BY n DESC, cluster) AS INTEGER) AS rank FROM sizes, t WHERE n >= 2 * least")
def donor_rank(spark, d):
    from pyspark.sql import Window

    sizes = _sizes(spark, d)
    donors = sizes.crossJoin(sizes.agg(F.min("n").alias("least"))).where(F.col("n") >= 2 * F.col("least"))
    return donors.select("cluster", "n", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")).alias("rank"))


@query(f"""WITH {DIST}, s AS (SELECT cluster, count(*) AS n FROM best GROUP BY cluster)
SELECT (SELECT round(avg(greatest(residual, 0)), 6) FROM best) AS obj_per_token, (SELECT round(avg(CASE WHEN label <> cluster THEN 1.0 ELSE 0.0 END), 6) FROM best) AS frac_changed,
min(n) AS size_min, max(n) AS size_max, quantile_disc(n, 0.5) AS size_median FROM s""")
def iteration_stats(spark, d):
    best = vectors.nearest(_distances(spark, d))
    sizes = best.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.agg(F.min("n").alias("size_min"), F.max("n").alias("size_max"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("size_median"))
    return rounded(vectors.objective(best).select(F.col("per_token").alias("obj_per_token")).crossJoin(vectors.labels_changed(best).select("frac_changed")).crossJoin(stats))


@query(f"WITH {DIST}, s AS (SELECT b.cluster, dim, avg(v) AS m FROM best b JOIN long USING (token_id) GROUP BY ALL) SELECT CAST(cluster AS INTEGER) AS cluster, dim, round(m, 6) AS m FROM s")
def kmeans_step(spark, d):
    tokens = X.tokens(spark, d)
    best = vectors.nearest(_distances(spark, d)).select("token_id", F.col("cluster").alias("label"))
    moved = vectors.centroids(tokens.drop("label").join(best, "token_id"))
    return rounded(moved.select("cluster", F.posexplode("mean").alias("dim", "m")))


@query(f"WITH {DIST} SELECT CAST(cluster AS INTEGER) AS cluster, round(sqrt(max(greatest(residual, 0))), 6) AS radius FROM best GROUP BY cluster")
def cluster_radius(spark, d):
    best = vectors.nearest(_distances(spark, d))
    return rounded(best.groupBy("cluster").agg(F.sqrt(F.max(F.greatest("residual", F.lit(0.0)))).alias("radius")))


# --- variance


@query(f"WITH {TRACE} SELECT CAST(cluster AS INTEGER) AS cluster, n, round(w, 6) AS w FROM w")
def cluster_weights(spark, d):
    return rounded(variance.weights(_point_model(spark, d)))


@query(f"WITH {TRACE} SELECT dim, round(g, 6) AS value FROM g")
def global_mean(spark, d):
    return rounded(variance.global_mean(_point_model(spark, d)))


@query(f"""WITH {TRACE} SELECT round(between_, 6) AS "between", round(within, 6) AS within, round(between_ + within, 6) AS total, CAST(0 AS DOUBLE) AS captured, round(within, 6) AS residual,
round(between_ / (between_ + within), 6) AS between_share, CAST(0 AS DOUBLE) AS captured_share, round(within / (between_ + within), 6) AS residual_share FROM parts""")
def variance_decomposition(spark, d):
    return rounded(variance.decomposition(_point_model(spark, d)))


# Eigenvalues and traces that both engines start from: powers of two by cluster, and a cluster without any.
EIGEN = "eig AS (SELECT CAST(c AS INTEGER) AS cluster, CAST(i AS INTEGER) AS i, CASE WHEN c = 5 THEN 0.0 ELSE 1.0 / power(1 + c, i) END AS e, 10 * (c + 1) AS n, CAST(4 + c AS DOUBLE) AS trace FROM range(6) a(c), range(4) b(i))"


def _eigen(spark):
    c = F.col("id").cast("int")
    values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(c == 5, 0.0).otherwise(1.0 / F.pow(1 + c, i)))
    return spark.range(6).select(c.alias("cluster"), values.alias("eigvals"), (10 * (F.col("id") + 1)).alias("n"), (4 + c).cast("double").alias("trace"))


@query(f"WITH {EIGEN}, p AS (SELECT cluster, n, sum(e) / max(trace) AS evr FROM eig GROUP BY cluster, n) SELECT round(sum(n * evr) / sum(n), 6) AS evr FROM p")
def weighted_evr(spark, d):
    return rounded(variance.weighted_evr(_eigen(spark)))


D80 = f"{EIGEN}, cum AS (SELECT cluster, sum(e) OVER (PARTITION BY cluster ORDER BY i) / greatest(sum(e) OVER (PARTITION BY cluster), 1e-12) AS f FROM eig), dims AS (SELECT cluster, CAST(count(*) FILTER (f < 0.8) + 1 AS BIGINT) AS d80 FROM cum GROUP BY cluster)"


@query(f"WITH {D80} SELECT cluster, d80 FROM dims")
def d80(spark, d):
    return variance.effective_dims(_eigen(spark))


@query(f"WITH {D80} SELECT min(d80) AS least, quantile_disc(d80, 0.5) AS median, max(d80) AS most FROM dims")
def d80_summary(spark, d):
    return variance.dims_summary(variance.effective_dims(_eigen(spark))).withColumn("median", F.col("median").cast("long"))


@query("SELECT CAST(range AS INTEGER) AS run, round(0.3 + range / 100, 6) AS held_out, 0.3 AS in_sample, round(range / 100, 6) AS gap, CASE WHEN range > 3 THEN 'overfit' ELSE 'generalizes' END AS verdict FROM range(7) WHERE range <> 3".replace("0.3 AS", "CAST(0.3 AS DOUBLE) AS"))
def overfit_verdict(spark, d):
    rows = spark.range(7).where("id <> 3").select(F.col("id").cast("int").alias("run"), (0.3 + F.col("id") / 100).alias("held_out"), F.lit(0.3).alias("in_sample"))
    return rounded(variance.verdicts(rows))


@query(f"""WITH {DECILES}, {GRID}, c AS (SELECT cell_id, label, count(*) AS n FROM assign GROUP BY ALL), dm AS (SELECT label FROM c QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, label) = 1),
o AS (SELECT label, count(*) AS owned FROM dm GROUP BY label), f AS (SELECT label, count(DISTINCT file_id) AS files FROM assign GROUP BY label), s AS (SELECT label, count(*) AS n FROM assign GROUP BY label)
SELECT label, n, round(n / (SELECT count(*) FROM assign), 6) AS w, coalesce(owned, 0) AS owned, files, round(cv, 6) AS cv FROM s LEFT JOIN o USING (label) JOIN f USING (label) JOIN cv USING (label) ORDER BY n DESC, label""")
def cluster_table(spark, d):
    assigned = _assign(spark, d)
    model = assigned.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    cv = spatial.variation(spatial.enrichment(_deciles(spark, d), "decile", K))
    out = variance.weights(model).withColumnRenamed("cluster", "label").join(spatial.owned_cells(assigned, K), "label").join(spatial.file_presence(assigned, K).drop("share"), "label").join(cv, "label")
    return rounded(out.orderBy(F.desc("n"), "label"))


# --- affinity


@query(f"WITH {PAIRS} SELECT i, j, round((1 + cosine) / 2, 6) AS affinity FROM pairs")
def point_affinity(spark, d):
    return rounded(affinity.point_affinity(_point_model(spark, d)))


@query(f"WITH {PAIRS} SELECT round(quantile_disc((1 + cosine) / 2, 0.5), 6) AS median, round(avg((1 + cosine) / 2), 6) AS mean, round(max((1 + cosine) / 2), 6) AS most FROM pairs")
def affinity_stats(spark, d):
    return rounded(affinity.affinity_stats(affinity.point_affinity(_point_model(spark, d))))


@query(f"WITH {PAIRS} SELECT i, j, round((1 + cosine) / 2, 6) AS affinity FROM pairs ORDER BY round((1 + cosine) / 2, 9) DESC, i, j LIMIT 12")
def top_affinity_pairs(spark, d):
    return rounded(affinity.top_pairs(affinity.point_affinity(_point_model(spark, d))))


# --- held-out tokens at dimension 0: files of odd number are held out

HOLD = f"""{TOKENS}, tm AS (SELECT label AS cluster, dim, avg(v) AS m, count(*) AS n FROM long WHERE file_id % 2 = 0 GROUP BY label, dim),
hd AS (SELECT token_id, cluster, sum((v - m) * (v - m)) AS r FROM long JOIN tm USING (dim) WHERE file_id % 2 = 1 GROUP BY ALL), hb AS (SELECT token_id, min(r) AS r FROM hd GROUP BY token_id),
hw AS (SELECT cluster, max(n) / sum(max(n)) OVER () AS w FROM tm GROUP BY cluster), hg AS (SELECT dim, sum(w * m) AS g FROM tm JOIN hw USING (cluster) GROUP BY dim),
hs AS (SELECT count(*) AS n, sum(greatest(r, 0)) AS residual FROM hb), ht AS (SELECT sum((v - g) * (v - g)) AS total FROM long JOIN hg USING (dim) WHERE file_id % 2 = 1),
hq AS (SELECT label AS cluster, sum(v * v) / count(DISTINCT token_id) AS sq FROM long WHERE file_id % 2 = 0 GROUP BY label),
hv AS (SELECT cluster, max(sq) - sum(m * m) AS trace FROM tm JOIN hq USING (cluster) GROUP BY cluster), ha AS (SELECT cluster, sum((m - g) * (m - g)) AS away FROM tm JOIN hg USING (dim) GROUP BY cluster),
hp AS (SELECT sum(w * trace) / (sum(w * trace) + sum(w * away)) AS in_sample, sum(w * trace) AS residual, sum(w * trace) + sum(w * away) AS total FROM hw JOIN hv USING (cluster) JOIN ha USING (cluster))"""


def _held(spark, d):
    """The model of the trained files, its table, and the held-out tokens."""
    tokens = X.tokens(spark, d)
    trained, out = tokens.where("file_id % 2 = 0"), tokens.where("file_id % 2 = 1")
    sq = trained.groupBy(F.col("label").alias("cluster")).agg(F.avg(vectors.squared_norm(F.col("features"))).alias("sq"))
    rows = vectors.centroids(trained).join(sq, "cluster")
    none = F.array()
    rows = rows.select("cluster", "mean", none.cast("array<array<double>>").alias("basis"), none.cast("array<double>").alias("eigvals"), (F.col("sq") - vectors.squared_norm(F.col("mean"))).alias("trace"), "n", F.lit(0.0).alias("evr"), F.lit(False).alias("reseeded"))
    return rows, subspaces.model_from(rows), out


@query(f"WITH {HOLD} SELECT n, round(residual, 6) AS residual FROM hs")
def holdout_residual(spark, d):
    _, model, out = _held(spark, d)
    return rounded(holdout.replay(out, model).select("n", "residual"))


@query(f"WITH {HOLD} SELECT round(total, 6) AS total, round(residual, 6) AS residual, round(in_sample, 6) AS residual_share FROM hp")
def insample_reference(spark, d):
    rows, _, _ = _held(spark, d)
    return rounded(variance.decomposition(rows).select("total", "residual", "residual_share"))


@query(f"WITH {HOLD} SELECT n, round(residual / total, 6) AS held_out, round(in_sample, 6) AS in_sample, CASE WHEN residual / total - in_sample > 0.03 THEN 'overfit' ELSE 'generalizes' END AS verdict FROM (SELECT n, hs.residual, ht.total, in_sample FROM hs, ht, hp)")
def holdout_summary(spark, d):
    rows, model, out = _held(spark, d)
    return rounded(holdout.evaluate(out, model, rows).select("n", "held_out", "in_sample", "verdict"))


# --- comparison

TABLE = f"""{ASSIGN}, t AS (SELECT label AS a, other AS b, count(*) AS n FROM assign GROUP BY ALL), ta AS (SELECT a, sum(n) AS na FROM t GROUP BY a), tb AS (SELECT b, sum(n) AS nb FROM t GROUP BY b), tt AS (SELECT sum(n) AS s FROM t)"""


@query(f"""WITH {TABLE}, mi AS (SELECT sum(n / s * ln(n * s / (na * nb))) AS mi FROM t JOIN ta USING (a) JOIN tb USING (b), tt), ea AS (SELECT -sum(na / s * ln(na / s)) AS h FROM ta, tt), eb AS (SELECT -sum(nb / s * ln(nb / s)) AS h FROM tb, tt)
SELECT round(mi / ((ea.h + eb.h) / 2), 6) AS nmi FROM mi, ea, eb""")
def nmi(spark, d):
    return rounded(compare.nmi(_assign(spark, d), "label", "other"))


@query(f"""WITH {TABLE}, c AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(na * (na - 1) / 2) FROM ta) AS x, (SELECT sum(nb * (nb - 1) / 2) FROM tb) AS y, (SELECT s * (s - 1) / 2 FROM tt) AS t)
SELECT round((s - x * y / t) / ((x + y) / 2 - x * y / t), 6) AS ari FROM c""")
def ari(spark, d):
    return rounded(compare.ari(_assign(spark, d), "label", "other"))


@query(f"""WITH {NEST}, {DOMINANT}, e AS (SELECT a.p AS a, b.p AS b FROM q a JOIN q b ON a.face = b.face AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)))
SELECT count(*) AS pairs, round(avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(8 * avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END), 6) AS times_chance
FROM e JOIN dom x ON x.cell_id = e.a JOIN dom y ON y.cell_id = e.b""")
def neighbor_agreement(spark, d):
    best = spatial.dominant(spatial.cell_cluster_counts(_assign(spark, d)))
    return rounded(compare.neighbour_agreement(best, healpix.neighbours(spark, NSIDE), K))


@query(f"WITH {COUNTS}, p AS (SELECT max(n) / sum(n) AS p FROM counts GROUP BY cell_id) SELECT count(*) AS cells, round(avg(p), 6) AS purity FROM p")
def mode_purity(spark, d):
    return rounded(spatial.purity(_assign(spark, d)))


@query(f"WITH {ASSIGN}, f AS (SELECT label AS cluster, count(*) AS found FROM assign GROUP BY label) SELECT cluster, found + CASE WHEN cluster = 3 THEN 1 ELSE 0 END AS saved, found FROM f WHERE cluster = 3")
def count_invariant(spark, d):
    assigned = _assign(spark, d)
    saved = assigned.groupBy(F.col("label").alias("cluster")).agg((F.count(F.lit(1)) + F.when(F.first("label") == 3, 1).otherwise(0)).alias("n"))
    return compare.count_mismatches(saved, assigned)


@query("SELECT fingerprint, count(*) AS runs, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT 'v' || range AS name, substr(sha1(CAST(range % 3 AS VARCHAR)), 1, 12) AS fingerprint FROM range(7)) GROUP BY fingerprint")
def comparable_runs(spark, d):
    runs = spark.range(7).select(F.concat(F.lit("v"), F.col("id")).alias("name"), F.substring(F.sha1((F.col("id") % 3).cast("string")), 1, 12).alias("fingerprint"))
    return compare.comparable_runs(runs)


# --- subspaces of dimension above 0: no SQL, tested against numpy

CONFIG = FitConfig(clusters=4, dim=3, iters=8, seed=7, min_count=8)


def _fitted(spark, d):
    tokens = X.tokens(spark, d).select("file_id", "cell_id", "features").persist()
    return tokens, subspaces.fit(tokens, CONFIG)


@query()
def ksubspace_fit(spark, d):
    _, model = _fitted(spark, d)
    return spark.createDataFrame(model.history).select("iter", "obj_per_token", "frac_changed", "size_min", "size_max", "size_median")


@query()
def subspace_residual(spark, d):
    tokens, model = _fitted(spark, d)
    return subspaces.assigned(tokens, model).select("file_id", "cell_id", "label", "residual")


@query()
def subspace_coords(spark, d):
    tokens, model = _fitted(spark, d)
    return subspaces.assigned(tokens, model).select("file_id", "cell_id", "label", "coords")


@query()
def subspace_affinity(spark, d):
    return affinity.subspace_affinity(spark, _fitted(spark, d)[1])


@query()
def subspace_variance(spark, d):
    return variance.decomposition(_fitted(spark, d)[1].rows(spark))


@query()
def subspace_evr(spark, d):
    return variance.weighted_evr(_fitted(spark, d)[1].rows(spark))


@query()
def subspace_d80(spark, d):
    return variance.effective_dims(_fitted(spark, d)[1].rows(spark))


@query()
def subspace_d80_summary(spark, d):
    return variance.dims_summary(subspace_d80(spark, d))


@query()
def subspace_verdict(spark, d):
    """The fit of the even files, judged on the odd ones."""
    tokens = X.tokens(spark, d).select("file_id", "cell_id", "features").persist()
    model = subspaces.fit(tokens.where("file_id % 2 = 0"), CONFIG)
    found = holdout.evaluate(tokens.where("file_id % 2 = 1"), model, model.rows(spark)).select("held_out", "in_sample")
    return variance.verdicts(found)


@query()
def sampled_runs(spark, d):
    """Runs of three file samples, two of them of one seed, by the fingerprint of what they sample."""
    runs = None
    for name, seed in (("a", 7), ("b", 8), ("c", 7)):
        one = sampling.fingerprint(sampling.sample_files(_assign(spark, d), 100, seed), X.CELLS, None).select(F.lit(name).alias("name"), "fingerprint")
        runs = runs.union(one) if runs else one
    return compare.comparable_runs(runs)


@query()
def subspace_reseeding(spark, d):
    """Each cluster of a fit of all tokens, whether it is under the least size, and the donor it would be split from."""
    tokens = X.tokens(spark, d).select("file_id", "cell_id", "features").persist()
    cfg = FitConfig(clusters=TOKEN_K, dim=3, iters=8, seed=7)  # the least size is the config's own
    return subspaces.reseeding(spark, subspaces.fit(tokens, cfg), cfg)


@query()
def kcenter_radius(spark, d):
    tokens = X.tokens(spark, d).select("file_id", "cell_id", "features").persist()
    return subspaces.radii(tokens, subspaces.farthest_points(tokens, 5, 7))


@query()
def seriation_rank(spark, d):
    matrix = affinity.affinity_matrix(_fitted(spark, d)[1])
    rank, colour = affinity.seriation(matrix, walk=False), affinity.colours(matrix)
    return spark.createDataFrame([(i, int(r), *map(float, c)) for i, (r, c) in enumerate(zip(rank, colour, strict=True))], "cluster int, rank int, r double, g double, b double, a double")


@query()
def grid_field(spark, d):
    from orrery.operators import render

    best = {r["cell_id"]: r["label"] for r in spatial.dominant(spatial.cell_cluster_counts(_assign(spark, d))).collect()}  # one row a cell
    colour = affinity.rainbow([i / (K - 1) for i in range(K)])
    rgb, _ = render.colour_grid(best, colour, NSIDE, 5.0)
    return spark.createDataFrame([(i, j, *map(float, rgb[i, j])) for i in range(rgb.shape[0]) for j in range(rgb.shape[1])], "row int, col int, r double, g double, b double")
