"""Token ids of all documents in binary files, in ascending order of doc_id, and back.

Documents are dealt out by ranges of doc_id, tokenized with the public library, and written in chunks of whole documents: a header with
their ids and lengths, then blocks of the range coder, each with a checksum and a model of its own. A chunk is a row of
a Parquet table (range, chunk, documents, ids, data) in the shared folder, so that any store that Spark reaches will do, lost tasks are simply written
again, and chunks are read back by any number of tasks. A longer document is a chunk of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from ledgertally.llm import pretokens, rangecoder
from ledgertally.llm.tables import slices
from ledgertally.sources.scratch import scratch_folder

MAGIC = b"LTOK0001"
#: A chunk is closed when it has so many ids.
CHUNK = 1 << 21
_FIELDS = "part int, chunk int, documents bigint, ids bigint, data binary"

_library: tuple[str, Tokenizer] | None = None
_known: dict[str | int, tuple[int, ...]] = {}


def _ids(texts: list[str], file: pretokens.TokenizerFile, path: str, said: str) -> list[np.ndarray]:
    """Ids of the texts. The library encodes each pre-token that the worker doesn't remember; ids never depend on what is around one."""
    global _library
    if _library is None or _library[0] != path:
        tokenizer = Tokenizer.from_str(said)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _library = (path, tokenizer)
        _known.clear()
    if len(_known) > pretokens.REMEMBERED:
        _known.clear()
    split = [file.pieces(text) for text in texts]
    new = list({p for pieces in split for p in pieces if p not in _known})
    words = [p for p in new if isinstance(p, str)]
    _known.update((p, (p,)) for p in new if isinstance(p, int))
    _known.update((p, tuple(e.ids)) for p, e in zip(words, _library[1].encode_batch(words, add_special_tokens=False), strict=True))
    return [np.fromiter(chain.from_iterable([_known[p] for p in pieces]), np.int64) for pieces in split]


def chunk_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return MAGIC + struct.pack("<Q", len(doc_ids)) + nulls + names + np.array(lengths, "<i8").tobytes() + rangecoder.encode(ids)


def read_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths, and the ids of all documents of a chunk."""
    if data[:8] != MAGIC:
        raise ValueError("not a chunk of token ids")
    (n,) = struct.unpack_from("<Q", data, 8)
    nulls = np.frombuffer(data, np.uint8, n, 16)
    names, lengths = (np.frombuffer(data, "<i8", n, 16 + n + k * 8 * n) for k in range(2))
    ids = rangecoder.decode(data[16 + 17 * n :])
    if len(ids) != lengths.sum():
        raise ValueError("a chunk's documents don't have its ids")
    return [None if null else int(d) for d, null in zip(names, nulls, strict=True)], lengths, ids


def write_ids(documents: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Writes the ids of every whole text (null: the empty one), each with `end_id` behind it, to a new folder.

    Documents follow each other by doc_id, null first; rows of one doc_id by their text. Columns other than doc_id and text are not read.
    doc_ids are integers.
    """
    with open(tokenizer_path, encoding="utf-8") as opened:
        said = opened.read()
    shared = documents.sparkSession.sparkContext.broadcast((pretokens.read(tokenizer_path), said))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, text_of_file = shared.value
        part, chunk = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal chunk, names, held, size
            data = chunk_bytes(names, [len(h) for h in held], np.concatenate(held))
            values = (part, chunk, len(names), size, data)
            names, held, size, chunk = [], [], 0, chunk + 1
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.large_binary() if len(data) > 1 << 30 else pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "chunk", "documents", "ids", "data"])

        for batch in slices(batches):
            found = _ids([t or "" for t in batch.column("text").to_pylist()], file, tokenizer_path, text_of_file)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                names.append(doc_id)
                held.append(np.append(ids, end_id))
                size += len(ids) + 1
                if size >= CHUNK:
                    yield closed()
        if names:
            yield closed()

    keys = [F.col("doc_id").cast("long").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(write, _FIELDS).write.parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """From files of `write_ids`: doc_id, start (ids of all documents before it), n_tokens, and ids or their CRC-32 (as little-endian unsigned 32-bit integers)."""
    chunks = spark.read.schema(_FIELDS).parquet(path)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, lengths, ids = read_chunk(batch.column("data")[row].as_py())
                before = np.cumsum(lengths) - lengths
                parts = [ids[a : a + n].astype("<u4") for a, n in zip(before.tolist(), lengths.tolist(), strict=True)]
                last = pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()) if digest else pa.array(parts, pa.list_(pa.int64()))
                place = [batch.column(c).take(pa.array([row] * len(names), pa.int32())) for c in ("part", "chunk")]
                yield pa.RecordBatch.from_arrays([*place, pa.array(names, pa.int64()), pa.array(before), pa.array(lengths), last], ["part", "chunk", "doc_id", "before", "n_tokens", "last"])

    kind = "last bigint" if digest else "last array<bigint>"
    documents = chunks.select("part", "chunk", "data").mapInArrow(read, f"part int, chunk int, doc_id bigint, before bigint, n_tokens bigint, {kind}")
    # Where chunks start: sums over ranges, of which there are as many as shuffle partitions, then over the chunks of a range.
    sizes = chunks.select("part", "chunk", "ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("of_chunk", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "chunk", (F.col("of_part") + F.col("of_chunk")).alias("first"))
    out = documents.join(starts, ["part", "chunk"])
    return out.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def packed(documents: DataFrame, tokenizer_path: str, end_id: int, digest: bool = False) -> DataFrame:
    """Writes the ids to a folder of their own in the shared one, and reads them back."""
    path = scratch_folder(documents.sparkSession, "token-ids")
    write_ids(documents, tokenizer_path, end_id, path)
    return read_ids(documents.sparkSession, path, digest)
