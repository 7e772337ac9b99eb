"""Combining one-row aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side without a join.

    Each part is a global aggregate (exactly one row) with its own column
    names. The rows are unioned (other parts' columns NULL) and one global
    aggregate takes each column's only non-NULL value.
    """
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])
