"""Where intermediate files go."""

from __future__ import annotations

import atexit
import contextlib
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Without that setting it is below the warehouse, which executors share too. What was written there goes when the program ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    path = f"{shared.rstrip('/')}/{label}-{uuid4().hex}"
    _made[path] = spark
    return path


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The rows of a frame, written as Parquet and read from there: what follows has a short lineage, which lost executors don't repeat."""
    path = scratch_folder(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remove_folder(path: str) -> None:
    """Deletes a scratch folder that nothing will read again, as far as its session still lives."""
    spark = _made.pop(path, None)
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def remove_folders() -> None:
    """Deletes the folders of this program that are left."""
    for path in list(_made):
        remove_folder(path)
