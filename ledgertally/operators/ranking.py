"""Sums per key and the k largest of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgertally.functions.numbers import WHOLE, as_double, is_number, sums, whole_order, whole_text


def sum_by(df: DataFrame, keys: Sequence[str], value: str, name: str = "total", whole: bool = False) -> DataFrame:
    """Exact sum per key. A number's is a double at the end or, with ``whole``, the text of a whole number of any length."""
    summed = sums(df, keys, [value])
    return summed.select(*keys, finished(summed, value, whole).alias(name, metadata=WHOLE if whole else {}))


def finished(summed: DataFrame, value: str, whole: bool = False) -> Column:
    """What a result shows of a total."""
    if not is_number(summed, value):
        return F.col(value)
    return whole_text(F.col(value)) if whole else as_double(summed, value)


def largest_first(df: DataFrame, measure: str) -> Column:
    """Descending order of numbers, whole numbers in texts among them."""
    return F.desc(measure) if df.schema[measure].metadata != WHOLE else whole_order(F.col(measure)).desc()


def top_k(df: DataFrame, measure: str, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The k rows with the largest measure; ties go to the smaller keys. Each task keeps only k rows."""
    return df.orderBy(largest_first(df, measure), *keys).limit(k)


def sum_top_k(df: DataFrame, keys: Sequence[str], value: str, k: int = 10, name: str = "total") -> DataFrame:
    return top_k(sum_by(df, keys, value, name), name, keys, k)
