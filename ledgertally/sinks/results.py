"""Results as JSON or CSV.

Every form is written by all tasks at once, a file for each, and holds a result of any size. ``single`` asks for one file instead, which one task
then streams: for reports, such as top-k lists or a row per month.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgertally.functions.numbers import WHOLE, double_text
from ledgertally.functions.texts import joined, json_scalar
from ledgertally.sources.results import read_pairs, read_rendered

# Fixed value: the time stamp in the name of a run's folder (no colons, which paths cannot hold).
RUN_STAMP = "%d-%m-%Y_%H_%M_%S"


def run_folder(base: str, label: str, now: datetime | None = None) -> str:
    """A folder of its own for every run."""
    return f"{base.rstrip('/')}/{label}_{(now or datetime.now()).strftime(RUN_STAMP)}"


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, in as many files as there are tasks."""
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header; one file for a report, one per task otherwise."""
    (df.coalesce(1) if single else df).write.mode("errorifexists").csv(path, header=True)


def write_json_array(df: DataFrame, path: str, value_as_text: bool = False, single: bool = False) -> None:
    """A JSON array in each file: ``[[k, v], …]``, or ``[[[k1, k2], v], …]`` when there are several key columns; the value is the last column."""
    *keys, value = df.columns
    _write_array(df, _pair(df, keys, value, value_as_text), path, single)


def write_rendered_array(df: DataFrame, path: str, separator: str = ",", single: bool = False) -> None:
    """A JSON array in each file: ``["k,v", …]``."""
    _write_array(df, json_scalar(rendered(df, separator)), path, single)


def rendered(df: DataFrame, separator: str = ",") -> Column:
    """All columns of a row as one joined text."""
    return joined(*[_plain(df, name) for name in df.columns], separator=separator)


def report_csv(
    spark: SparkSession, source: str, target: str, names: Sequence[str], form: str = "pairs"
) -> None:
    """Turn a JSON result file (``pairs`` or ``rendered``) into one CSV with these column names."""
    reader = {"pairs": read_pairs, "rendered": read_rendered}[form]
    write_csv(reader(spark, source, names), target, single=True)


def reheader(df: DataFrame, names: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The chosen columns under new titles."""
    return df.select(*(columns or df.columns)).toDF(*names)


def preview(df: DataFrame, rows: int = 10) -> None:
    df.limit(rows).show(rows, truncate=False)


def _plain(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return double_text(column) if isinstance(df.schema[name].dataType, T.DoubleType) else column.cast("string")


def _scalar(df: DataFrame, name: str, as_text: bool) -> Column:
    if as_text or isinstance(df.schema[name].dataType, T.StringType) and df.schema[name].metadata != WHOLE:
        return json_scalar(_plain(df, name))
    return F.coalesce(_plain(df, name), F.lit("null"))


def _pair(df: DataFrame, keys: Sequence[str], value: str, value_as_text: bool) -> Column:
    texts = [_scalar(df, key, False) for key in keys]
    key = texts[0] if len(texts) == 1 else F.concat(F.lit("["), joined(*texts, separator=", "), F.lit("]"))
    return F.concat(F.lit("["), key, F.lit(", "), _scalar(df, value, value_as_text), F.lit("]"))


def write_json_map(df: DataFrame, path: str, opening: str = "{", closing: str = "}", single: bool = False) -> None:
    """A JSON object in each file, from a key column and a column of JSON texts: ``{"k": …, …}``. The frame may have more around it."""
    key, value = df.columns
    _write_array(df, F.concat(json_scalar(F.col(key)), F.lit(": "), F.col(value)), path, single, opening, closing)


def _write_array(df: DataFrame, item: Column, path: str, single: bool, opening: str = "[", closing: str = "]") -> None:
    """Lines of one JSON array in each file: a bracket, an item behind a blank, the others behind commas, a bracket.

    A row that closes the array is added to each partition, behind the others; which row is the first one its number within the partition says.
    """
    spark = df.sparkSession
    files = 1 if single else int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = spark.range(0, files, 1, 1).select(F.lit(None).cast("string").alias("item"), F.col("id").cast("int").alias("file"), F.lit(2**63 - 1).alias("place"))
    items = df.select(item.alias("item"), F.pmod(F.spark_partition_id(), F.lit(files)).alias("file"), F.monotonically_increasing_id().alias("place"))
    rows = items.union(ends)
    rows = rows.coalesce(1) if single else rows.repartitionById(files, F.col("file")).sortWithinPartitions("place")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = F.when(first, F.concat(F.lit(f"{opening}\n"), F.coalesce(F.concat(F.lit(" "), "item"), F.lit(closing))))
    line = F.coalesce(line, F.concat(F.lit(","), "item"), F.lit(closing))
    rows.select(line.alias("value")).write.mode("errorifexists").text(path)
