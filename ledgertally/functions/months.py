"""Month keys that do not depend on the session time zone.

Grouping uses one small integer per row (``year * 12 + month - 1``); the text label is made after the
aggregation, on one row per month.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ledgertally.functions.checks import is_plain

SECONDS_PER_DAY = 86400
LAST_DAY = 2**31 - 1


def epoch_month(seconds: Column) -> Column:
    """Month index (UTC) of epoch seconds that pass ``in_calendar``."""
    return date_month(F.date_from_unix_date(F.floor(seconds / F.lit(SECONDS_PER_DAY)).cast("int")))


def in_calendar(seconds: Column) -> Column:
    """Do these seconds fall on a day that a date can hold? False for null."""
    return F.coalesce(F.abs(seconds) <= LAST_DAY * SECONDS_PER_DAY, F.lit(False))


def date_month(moment: Column) -> Column:
    """Month index of a date or zone-less timestamp."""
    return F.year(moment) * 12 + F.month(moment) - 1


def epoch_seconds(column: Column, data_type: T.DataType) -> Column:
    """Whole epoch seconds of a number, a text that passed a number check, or a timestamp with time zone."""
    if isinstance(data_type, T.StringType):
        rounded = F.floor(column.try_cast("double")).try_cast("bigint")
        return F.when(is_plain(column), column.try_cast("bigint")).otherwise(rounded)
    if isinstance(data_type, T.TimestampType):
        return F.unix_seconds(column)
    return F.floor(column).try_cast("bigint")


def month_label(index: Column, separator: str = "/") -> Column:
    """``MM/yyyy`` (or with another separator) of a month index."""
    month = F.lpad((F.pmod(index, F.lit(12)) + 1).cast("string"), 2, "0")
    return F.concat(month, F.lit(separator), F.floor(index / F.lit(12)).cast("string"))
