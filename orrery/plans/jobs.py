"""The runnable jobs as queries: each runs twice into one new folder and returns what lies there after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import corpus_drift, score_new_files
from orrery.functions.text import LETTERS
from orrery.plans.reference import DIST, MONTH
from orrery.sources.store import shared_folder


def _twice(spark: SparkSession, name: str, run, table: str):
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    run(spark, table, out)
    return run(spark, table, out)


def job1_score_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind token: the assignments; cube: the months' counts; dominant: the most frequent cluster of a cell (n: its tokens); flip: cells that change to the next month (n), of those in both, as residual their share."""
    found = _twice(spark, "job1", score_new_files.run, f"{sf_dir}/embeddings.parquet")
    columns = {"kind": "string", "month": "int", "file_id": "int", "cell_id": "int", "label": "int", "n": "long", "residual": "double"}
    kinds = {
        "token": found["assignments"].withColumn("n", F.lit(1)), "cube": found["cube"], "dominant": found["dominant"],
        "flip": found["flips"].select("month", F.col("both").alias("cell_id"), F.col("flips").alias("n"), F.col("rate").alias("residual")),
    }
    out = None
    for kind, df in kinds.items():
        part = df.withColumn("kind", F.lit(kind))
        part = part.select([(F.col(c) if c in part.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        out = part if out is None else out.union(part)
    return out.withColumn("residual", F.round("residual", 6))


def job2_corpus_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind document: the assignments; kind drift: the report's rows."""
    rows, drift = _twice(spark, "job2", corpus_drift.run, f"{sf_dir}/documents.parquet")
    columns = ("kind", "bucket", "cluster", "class", "doc_id", "residual", "n", "enrichment", "cv", "nmi", "ari", "purity")
    none = lambda *names: {c: F.lit(None).cast("double") for c in names}
    rows = rows.withColumns({"kind": F.lit("document"), "n": F.lit(1).cast("long")} | none("enrichment", "cv", "nmi", "ari", "purity")).select(*columns)
    drift = drift.withColumnRenamed("label", "cluster").withColumns({"kind": F.lit("drift"), "doc_id": F.lit(None).cast("long")} | none("residual")).select(*columns)
    out = rows.union(drift)
    return out.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_score_new_files": job1_score_new_files, "job2_corpus_drift": job2_corpus_drift}

_SCORED = f"""{DIST}, scored AS (SELECT {MONTH} AS month, file_id, cell_id, CAST(cluster AS INTEGER) AS label, greatest(residual, 0) AS residual FROM best JOIN tokens USING (token_id)),
mdom AS (SELECT month, cell_id, label, n FROM (SELECT month, cell_id, label, count(*) AS n FROM scored GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY month, cell_id ORDER BY n DESC, label) = 1),
flip AS (SELECT CAST(m AS INTEGER) AS month, count(b.label) AS both_, count(*) FILTER (a.label <> b.label) AS flips FROM range(1, 12) r(m) LEFT JOIN mdom a ON a.month = m LEFT JOIN mdom b ON b.month = m + 1 AND b.cell_id = a.cell_id GROUP BY m)"""
_COUNTS = ", ".join(f"CAST(strlen(t) - strlen(replace(t, '{c}', '')) AS DOUBLE)" for c in LETTERS)

ORACLES: dict[str, str] = {
    "job1_score_new_files": f"""WITH {_SCORED}
SELECT 'token' AS kind, month, file_id, cell_id, label, CAST(1 AS BIGINT) AS n, round(residual, 6) AS residual FROM scored
UNION ALL SELECT 'cube', month, NULL, cell_id, label, count(*), round(sum(residual), 6) FROM scored GROUP BY month, cell_id, label
UNION ALL SELECT 'dominant', month, NULL, cell_id, label, n, NULL FROM mdom
UNION ALL SELECT 'flip', month, NULL, CAST(both_ AS INTEGER), NULL, flips, round(flips / nullif(both_, 0), 6) FROM flip""",
    "job2_corpus_drift": f"""WITH c AS (SELECT doc_id, lang AS class, [{_COUNTS}] AS c FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
v AS (SELECT doc_id, class, list_transform(c, lambda x: x / greatest(list_sum(c), 1.0)) AS v FROM c),
top AS (SELECT class, count(*) AS n FROM v WHERE class IS NOT NULL GROUP BY class ORDER BY n DESC, class LIMIT 64),
known AS (SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS cluster FROM top),
long AS (SELECT doc_id, class, d, v[d] AS x FROM v, (SELECT unnest(range(1, {len(LETTERS) + 1})) AS d)),
means AS (SELECT cluster, d, avg(x) AS m FROM long JOIN known USING (class) GROUP BY cluster, d),
dist AS (SELECT doc_id, cluster, round(sum((x - m) * (x - m)), 9) AS r FROM long JOIN means USING (d) GROUP BY doc_id, cluster),
best AS (SELECT doc_id, cluster, r FROM dist QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r, cluster) = 1),
ends AS (SELECT min(doc_id) AS a, max(doc_id) AS b FROM documents),
rows_ AS (SELECT doc_id, class, cluster, r AS residual, CAST((doc_id - a) * 10 // (b - a + 1) AS INTEGER) AS bucket FROM best JOIN v USING (doc_id), ends),
bucket AS (SELECT bucket AS b, cluster AS label, count(*) AS n FROM rows_ GROUP BY ALL),
per_b AS (SELECT b, sum(n) AS bn FROM bucket GROUP BY b), per_l AS (SELECT k.cluster AS label, class, coalesce(sum(n), 0) AS ln FROM known k LEFT JOIN bucket ON label = k.cluster GROUP BY ALL),
grid AS (SELECT b, label, class, CAST(coalesce(n, 0) AS BIGINT) AS n, (coalesce(n, 0) / greatest(ln, 1)) / greatest(bn / (SELECT sum(n) FROM bucket), 1e-12) AS e FROM per_b CROSS JOIN per_l LEFT JOIN bucket USING (b, label)),
cv AS (SELECT label, stddev_pop(e) / greatest(avg(e), 1e-12) AS cv FROM grid GROUP BY label),
t AS (SELECT cluster AS a, class AS b, count(*) AS n FROM rows_ WHERE class IS NOT NULL GROUP BY ALL), ta AS (SELECT a, sum(n) AS na FROM t GROUP BY a), tb AS (SELECT b, sum(n) AS nb FROM t GROUP BY b), tt AS (SELECT sum(n) AS s FROM t),
mi AS (SELECT sum(n / s * ln(n * s / (na * nb))) AS mi FROM t JOIN ta USING (a) JOIN tb USING (b), tt), ea AS (SELECT -sum(na / s * ln(na / s)) AS h FROM ta, tt), eb AS (SELECT -sum(nb / s * ln(nb / s)) AS h FROM tb, tt),
ch AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(na * (na - 1) / 2) FROM ta) AS x, (SELECT sum(nb * (nb - 1) / 2) FROM tb) AS y, (SELECT s * (s - 1) / 2 FROM tt) AS t),
agree AS (SELECT CASE WHEN ea.h + eb.h > 0 THEN mi / ((ea.h + eb.h) / 2) ELSE 1.0 END AS nmi, (ch.s - x * y / ch.t) / ((x + y) / 2 - x * y / ch.t) AS ari, (SELECT avg(p) FROM (SELECT max(n) / sum(n) AS p FROM t GROUP BY a)) AS purity FROM mi, ea, eb, ch)
SELECT 'document' AS kind, bucket, cluster, class, doc_id, round(residual, 6) AS residual, CAST(1 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS enrichment, CAST(NULL AS DOUBLE) AS cv, CAST(NULL AS DOUBLE) AS nmi, CAST(NULL AS DOUBLE) AS ari, CAST(NULL AS DOUBLE) AS purity FROM rows_
UNION ALL SELECT 'drift', b, label, class, NULL, NULL, n, round(e, 6), round(cv, 6), round(nmi, 6), round(ari, 6), round(purity, 6) FROM grid JOIN cv USING (label), agree""",
}
