"""Line dedup against brute force and DuckDB."""

import hashlib
import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from orrery.llm.lines import ORACLE, Runs, drop_shared_lines, line_keys
from orrery.llm.queries import op11_line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, common=3, least=20):
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None:
                held[key_of(line)].add(doc)
    gone = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= common}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in gone or gone[key_of(x)] == doc]
        out.append((doc, "\n".join(kept).encode(), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def found(df, **kw):
    return sorted(((r["doc_id"], bytes(r["kept"]), r["n_lines"], r["n_dropped"]) for r in drop_shared_lines(df, **kw).collect()), key=str)


EDGES = [
    (1, None), (2, ""), (3, "\n"), (4, "Short\nshort"), (5, "Short"), (6, "short"),
    (7, "A line that is Long enough\nown words of seven, long too"), (8, "  a line that is long enough\t\r\n\n"), (9, "\x0bA LINE THAT IS LONG ENOUGH"), (9, "another row of nine, long enough"),
    (10, "ééééééééééééééééééé"), (11, "ééééééééééééééééééé"), (12, "ééééééééééééééééééé"),  # 19 code points of 38 bytes
    (13, "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"), (14, "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"), (15, "éÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ\nÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"),
    (16, "twice in two documents only\ntwice in two documents only"), (17, "twice in two documents only"), (17, "twice in two documents only"),
    (None, "a line that is long enough\nnobody counts me, nobody counts"), (None, "nobody counts me, nobody counts"), (None, "nobody counts me, nobody counts"),
    (18, "\n".join(["repeated inside, all stay in the holder"] * 3)), (19, "repeated inside, all stay in the holder"), (20, "\n".join(["repeated inside, all stay in the holder"] * 2)),
    (-5, "a line that is long enough"), (21, "x" * 3_000_000 + "\n" + "a line that is long enough"),
]


def test_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").repartition(3)
    assert found(df) == brute(EDGES)
    assert found(df, batches=1) == found(df, batches=5, fan=2) == brute(EDGES)
    assert found(df.repartition(1), common=2, least=5, batches=3) == brute(EDGES, 2, 5)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    assert found(df.limit(0)) == []
    names = ("batch", "doc", "copy", "drops", "kept", "n_lines", "n_dropped", "of", "as", "h1", "owner", "document")
    wide = df.withColumns({c: F.lit("old") for c in names})
    assert found(wide) == brute(EDGES)
    carried = drop_shared_lines(wide, carry=True).collect()
    assert len(carried) == len(EDGES) and all(r["document"]["kept"] == "old" for r in carried)
    assert sorted(((r["document"]["doc_id"], bytes(r["kept"]), r["n_lines"], r["n_dropped"]) for r in carried), key=str) == brute(EDGES)


def test_random_batches_in_any_order(spark):
    rng = random.Random(11)
    pool = [f"common line number {i} of the pool, long enough" for i in range(40)]
    rows = [(rng.randrange(60), "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line {rng.random()} of its own, long enough" for _ in range(rng.randrange(6)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, batches=7, fan=2) == brute(rows)
    keys = df.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(line) >= 20").select(F.xxhash64("line").alias("h1"), F.lit(0).cast("long").alias("h2"), F.col("doc_id").alias("doc"))
    want = {(r["h1"], r["n"], r["owner"]) for r in keys.distinct().groupBy("h1").agg(F.count("*").alias("n"), F.max("doc").alias("owner")).collect() if r["n"] >= 3}
    runs = Runs(spark, 4, fan=2)
    for part in (3, 0, 4, 1, 2):  # owners arrive late: a run's common key may still get a larger holder
        runs.add(keys.where(F.col("doc") % 5 == part))
    assert runs.written > 5 and runs.levels[0] < 2
    got = {(r["h1"], r["owner"]) for r in runs.shared_lines().collect()}
    assert got == {(h, owner) for h, _, owner in want}


def test_line_keys():
    same = line_keys("  Ab" .encode() + b"c" * 20 + b"\r\nab" + b"c" * 20 + b"\nab", 20)
    assert same[0] == same[1] is not None and same[2] is None and len(same[0]) == 16


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = sorted((doc, n, gone, hashlib.sha256(kept).hexdigest()) for doc, kept, n, gone in brute(rows))
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in op11_line_dedup(spark, d).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == want == sorted(con.execute(ORACLE).fetchall())
    assert sum(x[2] for x in got) > 0
