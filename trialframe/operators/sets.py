"""Set differences and overlaps of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def exclude_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``; null equals null."""
    return a.subtract(b)


def overlap_set(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
