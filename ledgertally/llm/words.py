"""Words of a batch of texts as arrays: boundaries and 64-bit fingerprints, without a Python object per word.

A word is a run of bytes other than the six ASCII blanks. Fingerprints stand for words in counts and sets; two of n
different words share one with odds of n * n / 2**65.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier modulo 2**64, at least."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            factors = np.full(2 * n, 0xD1342543DE82EF95, np.uint64)
            factors[0] = 1
            _powers = np.multiply.accumulate(factors)
    return _powers


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins (one more at the end); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """starts, ends: byte positions of each word; first: of each text its first word (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The number of its text for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def fingerprints(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        begins = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
        values = _OF_BYTE[self.data[np.repeat(self.starts, sizes) + place]]
        with np.errstate(over="ignore"):
            values *= powers(int(sizes.max()))[place]
            return mixed(np.add.reduceat(values, begins) + sizes.astype(np.uint64))


def words(column: pa.Array, lower: bool, letters: bool = False) -> Words:
    """lower: A-Z count as a-z; other letters stay. letters: all ASCII characters but letters separate words, as blanks do."""
    data, offsets = buffer(column)
    if lower:
        data = _LOWER[data]
    outside = np.ones(len(data) + 1, bool)
    outside[:-1] = (_NO_LETTER if letters else _SPACE)[data]
    new = np.zeros(len(data) + 1, bool)  # a text begins here
    new[offsets] = True
    before = np.ones(len(data) + 1, bool)
    before[1:] = outside[:-1]
    starts = np.flatnonzero(~outside & (before | new))
    ends = np.flatnonzero(~before & (outside | new))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))
