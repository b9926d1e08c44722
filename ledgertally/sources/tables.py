"""Typed CSV, the nested scam registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ledgertally.sources.layouts import REGISTRY_SCHEMA


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line. Without a schema the types are inferred, which reads the files one more time.

    With one, the header has to name its columns in its order, and a cell of another type stops the job.
    """
    if schema is None:
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def read_registry(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The scam registry: one JSON document per line, its entries in the map ``result``.

    The schema is given, since inference would make one struct field of every registry key. A broken document
    stops the job: a registry that silently reads as empty would give an empty answer.
    """
    return spark.read.schema(REGISTRY_SCHEMA).json(path, mode="FAILFAST")
