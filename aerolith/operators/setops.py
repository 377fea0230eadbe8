"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union all by name; columns missing on one side become null."""
    return a.unionByName(b, allowMissingColumns=True)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Unique values of one column."""
    return df.select(col).distinct()
