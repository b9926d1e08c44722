"""Quantiles per key from sketches that can be merged.

Each task makes a sketch of its rows of a key, and only sketches are shuffled: a key with a third of all rows is one sketch per task. With the default size a
quantile's rank is off by 1.33 % or less in 99 of 100 cases, and exact for keys of no more rows than the size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Items that a sketch keeps on its largest level.
SIZE = 200
RANK_ERROR = 0.0133


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, name: str = "sketch", size: int = SIZE) -> DataFrame:
    """One sketch per key of a double column; nulls are left out, and a key without a value has no sketch."""
    sketch = F.kll_sketch_agg_double(F.col(value), F.lit(size))
    return df.groupBy(*keys).agg(F.when(F.count(value) > 0, sketch).alias(name))


def merged_sketches(df: DataFrame, keys: Sequence[str], name: str = "sketch", size: int = SIZE) -> DataFrame:
    """The sketches of coarser keys."""
    return df.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.kll_merge_agg_double(F.col(name), F.lit(size)).alias(name))


def with_quantiles(df: DataFrame, quantiles: dict[str, float], name: str = "sketch") -> DataFrame:
    """The sketch replaced by its quantiles."""
    found = {title: F.when(F.col(name).isNotNull(), F.kll_sketch_get_quantile_double(F.col(name), F.lit(share))) for title, share in quantiles.items()}
    return df.select("*", *[column.alias(title) for title, column in found.items()]).drop(name)
