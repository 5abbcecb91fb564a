"""Texts as vectors, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text: Column) -> Column:
    """How often each small letter a-z is in the whole text; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.array(*[(F.octet_length(body) - F.octet_length(F.replace(body, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def shares(counts: Column) -> Column:
    """Counts over their sum; all zeros where nothing was counted.  ``counts`` should be a stored column: it is used more than once."""
    total = F.greatest(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    return F.zip_with(counts, F.array_repeat(total, F.size(counts)), lambda x, all_: x / all_)
