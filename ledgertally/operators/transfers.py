"""Transfers from an address to itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def self_pairs(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rows whose two columns are equal; two empty texts are equal, nulls are not."""
    return df.where(F.col(source) == F.col(target))
