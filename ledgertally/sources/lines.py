"""Comma-separated text lines with bad lines among them.

The CSV reader is not used here: it gives quotes a meaning and pads or cuts lines of another arity, while a
line counts here only when a plain split on commas gives exactly the expected number of fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertally.functions.checks import is_float, is_int
from ledgertally.sources.layouts import Layout


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines, header included, as column ``value``."""
    return spark.read.text(path)


def split_fields(lines: DataFrame, layout: Layout) -> DataFrame:
    """Lines of the right arity, their used fields as named text columns.

    The one-element explode keeps the optimizer from copying the split into every check and column that
    uses it, so each line is split once (measured: half the time of the plain form). It makes no extra rows.
    """
    parts = lines.select(F.explode(F.array(F.split("value", ",", -1))).alias("parts"))
    return parts.where(F.size("parts") == layout.arity).select(
        *[F.col("parts")[position].alias(name) for name, position in layout.columns.items()]
    )


def read_fields(spark: SparkSession, path: str | list[str], layout: Layout) -> DataFrame:
    return split_fields(read_lines(spark, path), layout)


def well_formed(fields: DataFrame, ints: Sequence[str] = (), floats: Sequence[str] = ()) -> DataFrame:
    """Rows whose named fields hold integers / finite decimals. A header line fails it by its titles."""
    for name in ints:
        fields = fields.where(is_int(F.col(name)))
    for name in floats:
        fields = fields.where(is_float(F.col(name)))
    return fields


def without_header(fields: DataFrame, column: str, title: str) -> DataFrame:
    """Drop header lines by the literal title of one column."""
    return fields.where(F.col(column) != title)


def stage_fields(fields: DataFrame, path: str) -> None:
    """Write split fields as parquet, so that later questions read only the columns they use.

    The fields stay text and keep their bad values: every question applies its own checks, as on the raw lines.
    """
    fields.write.mode("errorifexists").parquet(path)


def read_staged(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """Staged fields; an error if the files hold other columns than the layout's."""
    staged = spark.read.parquet(path)
    if set(staged.columns) != set(layout.columns):
        raise ValueError(f"{path} holds {sorted(staged.columns)}, not {sorted(layout.columns)}")
    return staged.select(*layout.columns)
