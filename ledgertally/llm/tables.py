"""Input tables, tables kept in the shared folder, and batches of bounded size for the tasks."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ledgertally.sources.scratch import remove_folder, scratch_folder
from ledgertally.workers import importable

#: A task works on slices of about so many bytes of text; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_passing: list[list[str]] = []


@contextmanager
def passing() -> Iterator[None]:
    """Tables stored inside, but for those to keep, are deleted at the end: by then what is read from them has been stored itself."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove_folder(path)


def stored(frame: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """The rows of a frame, written as Parquet to the shared folder and read from there: lost executors don't recompute them. With `keep` the table outlives the innermost `passing`."""
    importable(frame.sparkSession)
    path = scratch_folder(frame.sparkSession, label)
    of = len(_passing) - 1 - keep
    if of >= 0:
        _passing[of].append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def released() -> None:
    """Gives the memory that this process freed back to the system: Arrow's pool and the C heap keep it otherwise, and a Python worker that
    Spark reuses would carry the largest slice of every task it ran into the next stage."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


_libc = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None
if _libc is not None and not hasattr(_libc, "malloc_trim"):
    _libc = None


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in the same order, in slices of about `limit` bytes of one column. When they are all taken, freed memory is released."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        yield batch.slice(start)
    released()
