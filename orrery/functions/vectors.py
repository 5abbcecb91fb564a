"""Vector expressions over array columns of doubles; JVM-side, for reports and checks rather than the fit's hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def unit(a: Column, least: float = 1e-12) -> Column:
    """a over its norm; norms under ``least`` count as that."""
    norm = F.greatest(F.sqrt(squared_norm(a)), F.lit(least))
    return F.transform(a, lambda x: x / norm)


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(squared_norm(a)), F.lit(least)) * F.greatest(F.sqrt(squared_norm(b)), F.lit(least)))
