"""How many bytes each column of a table takes, by the length of its texts. One pass, one shuffled row per task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ledgertally.functions.texts import hex_bytes, text_length


def _measured(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """One row with every column's bytes over all rows. Nulls are left out of the mean but count as rows."""
    quoted = [F.col("`" + name.replace("`", "``") + "`") for name in columns]
    means = df.agg(
        F.count("*").alias("rows"), *[F.avg(text_length(c)).alias(f"mean_{i}") for i, c in enumerate(quoted)]
    )
    sizes = means.select(*[(hex_bytes(F.col(f"mean_{i}")) * F.col("rows")).alias(f"b{i}") for i in range(len(quoted))])
    return sizes, [F.col(f"b{i}") for i in range(len(quoted))]


def column_bytes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, size_bytes`` of the named columns, all by default."""
    names = list(columns or df.columns)
    sizes, values = _measured(df, names)
    pairs = [part for name, value in zip(names, values) for part in (F.lit(name), value)]
    return sizes.select(F.stack(F.lit(len(names)), *pairs).alias("column_name", "size_bytes"))


def column_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, space_saved, percentage_saved``: each column's bytes and its part of all of them."""
    names = list(columns or df.columns)
    sizes, values = _measured(df, names)
    total = reduce(add, values)
    triples = [
        part
        for name, value in zip(names, values)
        for part in (F.lit(name), value, F.try_divide(value, total) * 100)
    ]
    return sizes.select(
        F.stack(F.lit(len(names)), *triples).alias("column_name", "space_saved", "percentage_saved")
    )
