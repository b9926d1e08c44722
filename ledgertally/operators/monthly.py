"""Counts, sums and means per calendar month.

The shuffle behind each of these carries one row per month and input partition, however many rows share a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgertally.functions.months import date_month, epoch_month, epoch_seconds, in_calendar, month_label
from ledgertally.functions.numbers import as_double, sums

MONTH = "month_index"


def with_month(df: DataFrame, time: str) -> DataFrame:
    """Add the month index of epoch seconds, a date or a timestamp; moments outside the calendar are dropped."""
    data_type = df.schema[time].dataType
    if isinstance(data_type, (T.DateType, T.TimestampNTZType)):
        return df.where(F.col(time).isNotNull()).withColumn(MONTH, date_month(F.col(time)))
    seconds = epoch_seconds(F.col(time), data_type)
    return df.where(in_calendar(seconds)).withColumn(MONTH, epoch_month(seconds))


def labelled(df: DataFrame, separator: str = "/") -> Column:
    return month_label(F.col(MONTH), separator).alias("month")


def in_month_order(df: DataFrame, chronological: bool = False, limit: int | None = None) -> DataFrame:
    """Sort by the label as text (01/2016, 01/2017, …) or by time, then keep the first ``limit`` rows if given."""
    if chronological:
        month, year = F.substring("month", 1, 2), F.substring("month", 4, 10)
        df = df.orderBy(year.cast("int"), month)
    else:
        df = df.orderBy("month")
    return df if limit is None else df.limit(limit)


def count_by_month(df: DataFrame, time: str, name: str = "transactions") -> DataFrame:
    counted = with_month(df, time).groupBy(MONTH).agg(F.count("*").alias(name))
    return counted.select(labelled(counted), name)


def average_by_month(df: DataFrame, time: str, value: str, name: str = "average") -> DataFrame:
    """Mean of a value per month over the rows that have one: one exact sum, one division."""
    summed = sums(with_month(df, time), [MONTH], [value])
    return summed.select(labelled(summed), (as_double(summed, value) / F.nullif(F.col(f"{value}_rows"), F.lit(0))).alias(name))
