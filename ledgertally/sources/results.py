"""Result files read back as tables, line by line, however large they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertally.functions.texts import stripped


def _items(spark: SparkSession, path: str, item_type: str) -> DataFrame:
    """Items of JSON arrays: one on each line behind a blank or a comma, as the sinks write them, or whole arrays on a line."""
    lines = spark.read.text(path).where(~F.col("value").isin("[", "]", ""))
    one = F.substring("value", 1, 1).isin(" ", ",")
    whole = F.when(one, F.concat(F.lit("["), F.substr("value", F.lit(2)), F.lit("]"))).otherwise(F.col("value"))
    return lines.select(F.explode(F.from_json(whole, f"array<{item_type}>", {"mode": "FAILFAST"})).alias("item"))


def read_pairs(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """``[[k, v], …]`` as two text columns, or ``[[[k1, k2], v], …]`` as three: as many as there are names."""
    items = _items(spark, path, "array<string>")
    *key_names, value_name = names
    key, value = F.col("item")[0], F.col("item")[1]
    if len(key_names) == 1:
        keys = [key.alias(key_names[0])]
    else:
        parts = F.from_json(key, "array<string>", {"mode": "FAILFAST"})
        keys = [parts[i].alias(name) for i, name in enumerate(key_names)]
    return items.select(*keys, value.alias(value_name))


def read_rendered(spark: SparkSession, path: str, names: Sequence[str], separator: str = ",") -> DataFrame:
    """``["k,v", …]`` as text columns, without stray brackets or quotes."""
    items = _items(spark, path, "string")
    return items.select(*split_rendered(F.col("item"), names, separator))


def split_rendered(text, names: Sequence[str], separator: str = ","):
    """Columns of a comma-joined text."""
    parts = F.split(stripped(text, '[]"'), separator, len(names))
    return [stripped(parts[i], ' "').alias(name) for i, name in enumerate(names)]


def read_result_csv(spark: SparkSession, path: str, names: Sequence[str], header: bool = True) -> DataFrame:
    """A result CSV under new column names. Say ``header=False`` for a file without one, or its first row is lost."""
    return spark.read.csv(path, header=header, inferSchema=True).toDF(*names)
