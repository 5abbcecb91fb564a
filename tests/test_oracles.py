"""Every query with SQL against DuckDB, on both small table sets."""

import math

import duckdb
import pytest

import orrery.plans.literal  # noqa: F401  registers its queries
from orrery.plans.reference import ORACLES, QUERIES


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=str)
    df = QUERIES[name](spark, d)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    assert len(got) == len(want) > 0
    assert all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True)), [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
