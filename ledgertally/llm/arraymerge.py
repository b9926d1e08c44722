"""Token counts by rank-synchronous merging of arrays.

Pre-tokens lie side by side in one array of symbols. In each round every sequence finds its lowest-ranked neighbouring pair,
all places of that pair in that sequence merge at once (from the left where they overlap), and sequences without a pair
leave with the number of symbols they have. A worker keeps the counts of pre-tokens it has met.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgertally.llm import pretokens
from ledgertally.llm.tables import slices
from ledgertally.llm.words import buffer

_NONE = np.int32(2**31 - 1)


class MergeTable:
    """Pairs of symbols as sorted keys, with rank and merged symbol of each."""

    def __init__(self, file: pretokens.TokenizerFile):
        letters = pretokens.byte_letters()
        self.symbol = np.array([file.vocab[c] for c in letters], np.int64)
        pairs = {}
        for rank, (left, right) in enumerate(file.merges):
            pairs.setdefault((file.vocab[left] << 32) | file.vocab[right], (rank, file.vocab[left + right]))
        self.keys = np.array(sorted(pairs), np.int64)
        found = np.array([pairs[k] for k in self.keys.tolist()], np.int64).reshape(-1, 2)
        self.ranks, self.merged = found[:, 0].astype(np.int32), found[:, 1]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (a large number if there is none) and merged symbol of each pair."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32), left
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.merged[at]


def merged_sizes(pieces: list[str], table: MergeTable) -> np.ndarray:
    """The number of symbols that each pre-token ends with."""
    data, offsets = buffer(pa.array(pieces, pa.large_string()))
    symbols, sizes = table.symbol[data], np.diff(offsets)
    which = np.repeat(np.arange(len(pieces)), sizes)
    done = sizes.copy()
    rank = np.full(len(symbols), _NONE, np.int32)
    merged = np.zeros(len(symbols), np.int64)
    if len(symbols):
        rank[:-1], merged[:-1] = table.find(symbols[:-1], symbols[1:])
        rank[:-1][which[:-1] != which[1:]] = _NONE
    while len(symbols):
        begins = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        sizes = np.diff(np.append(begins, len(symbols)))
        least = np.minimum.reduceat(rank, begins)
        live = least < _NONE
        done[which[begins]] = sizes
        if not live.all():
            stay = np.repeat(live, sizes)
            symbols, which, rank, merged = symbols[stay], which[stay], rank[stay], merged[stay]
            sizes, least = sizes[live], least[live]
        if not len(symbols):
            break
        hit = rank == np.repeat(least, sizes)
        places = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), places, 0))
        hit &= (places - run) % 2 == 0  # neighbours of one run overlap: every other one merges
        at = np.flatnonzero(hit)
        symbols[at] = merged[at]
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        symbols, which, rank, merged = symbols[left], which[left], rank[left], merged[left]
        at -= np.arange(len(at))
        near = np.unique(np.concatenate([at, at - 1]))  # only pairs beside a merged symbol are new
        near = near[(near >= 0) & (near < len(symbols) - 1)]
        rank[at] = _NONE
        rank[near], merged[near] = table.find(symbols[near], symbols[near + 1])
        rank[near[which[near] != which[near + 1]]] = _NONE
    return done


_known: dict[str, int] = {}
_table: tuple[object, MergeTable] | None = None


def token_counts(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens of the whole text. A null or empty text has none of either.

    Every input row gives one row, repeated or null doc_ids too; other columns are not read. The tokenizer file is read
    where the plan is built and sent to the tasks (a few MB).
    """
    spark = documents.sparkSession
    file = spark.sparkContext.broadcast(pretokens.read(tokenizer_path))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _table
        if _table is None or _table[0] != tokenizer_path:
            _known.clear()
            _table = (tokenizer_path, MergeTable(file.value))
        for batch in slices(batches):
            split = [file.value.pieces(text or "") for text in batch.column("text").to_pylist()]
            if len(_known) > pretokens.REMEMBERED:
                _known.clear()
            new = list({piece for pieces in split for piece in pieces if isinstance(piece, str) and piece not in _known})
            _known.update(zip(new, merged_sizes(new, _table[1]).tolist(), strict=True))
            known = _known
            tokens = [sum([1 if isinstance(p, int) else known[p] for p in pieces]) for pieces in split]
            n_bytes = np.diff(buffer(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
