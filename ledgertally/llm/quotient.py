"""Counting quotient filters that lose nothing: sorted, compact tables of keys and counts as bytes.

A key is an array of 64-bit limbs. An invertible permutation spreads its first limb, whose leading bits tell which range of keys a filter is for, whose next
bits are the quotient, and whose other bits, with the other limbs, are the remainder, kept in full. A key's slot is its quotient, or the next free one:
keys of a quotient stand in a run, in order of their remainders. One bit for each quotient says whether it has a run, one for each slot whether a run ends
there; with both, a slot's quotient is read off. Counts take a byte in the slot; larger ones go to a list behind the slots.
"""

from __future__ import annotations

import struct

import numpy as np

_FACTORS = (0x9FB21C651E98DF25, 0xD1342543DE82EF95)
_HEAD = struct.Struct("<BBBBQQQ")  # bits, range bits, quotient bits, limbs, range, slots, large counts


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permuted(x: np.ndarray, bits: int) -> np.ndarray:
    """A permutation of the numbers below 2**bits, for 62 to 64 bits."""
    with np.errstate(over="ignore"):
        for factor in _FACTORS:
            x = (x * np.uint64(factor)) & _mask(bits)
            x = x ^ (x >> np.uint64(32))
    return x


def restored(x: np.ndarray, bits: int) -> np.ndarray:
    """What `permuted` was given."""
    with np.errstate(over="ignore"):
        for factor in reversed(_FACTORS):
            x = x ^ (x >> np.uint64(32))
            x = (x * np.uint64(pow(factor, -1, 1 << bits))) & _mask(bits)
    return x


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[begins], np.add.reduceat(counts, begins)


def encode(keys: np.ndarray, counts: np.ndarray, bits: int, range_bits: int) -> bytes:
    """The filter of sorted, distinct, permuted keys of one range. Counts are 1 or more."""
    n, limbs = keys.shape
    own = bits - range_bits
    prefix = int(keys[0, 0]) >> own
    rest = keys[:, 0] & _mask(own)
    q = min(own, max(0, (n - 1).bit_length()))
    quotient = (rest >> np.uint64(own - q)).astype(np.int64) if q else np.zeros(n, np.int64)
    at = np.arange(n) + np.maximum.accumulate(quotient - np.arange(n))
    slots = max(1 << q, int(at[-1]) + 1)
    occupied, ends = np.zeros(1 << q, bool), np.zeros(slots, bool)
    occupied[quotient] = True
    ends[at[np.append(quotient[1:] != quotient[:-1], True)]] = True
    width = -(-(own - q) // 8)
    remainders = np.zeros((slots, width + 8 * (limbs - 1)), np.uint8)
    remainders[at, :width] = (rest & _mask(own - q))[:, None].view(np.uint8).reshape(n, 8)[:, :width]
    remainders[at, width:] = np.ascontiguousarray(keys[:, 1:]).view(np.uint8).reshape(n, -1)
    small = np.zeros(slots, np.uint8)
    small[at] = np.minimum(counts, 255)
    large = counts[counts >= 255].astype(np.uint64)
    head = _HEAD.pack(bits, range_bits, q, limbs, prefix, slots, len(large))
    return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders.tobytes(), small.tobytes(), large.tobytes()])


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and their counts."""
    bits, range_bits, q, limbs, prefix, slots, larges = _HEAD.unpack_from(data)
    own = bits - range_bits
    width = -(-(own - q) // 8)
    sizes = [-(-(1 << q) // 8), -(-slots // 8), slots * (width + 8 * (limbs - 1)), slots, 8 * larges]
    ends_at = np.cumsum([_HEAD.size, *sizes])
    parts = [np.frombuffer(data, np.uint8, size, begin) for size, begin in zip(sizes, ends_at)]
    used = np.flatnonzero(parts[3])
    ends = np.unpackbits(parts[1], count=slots)[used]
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(np.unpackbits(parts[0], count=1 << q))[run].astype(np.uint64)
    remainders = parts[2].reshape(slots, -1)[used]
    low = np.zeros((len(used), 8), np.uint8)
    low[:, :width] = remainders[:, :width]
    keys = np.empty((len(used), limbs), np.uint64)
    high = np.uint64(prefix << own) if range_bits else np.uint64(0)
    keys[:, 0] = high | (quotient << np.uint64(own - q) if q else np.uint64(0)) | low.view(np.uint64)[:, 0]
    keys[:, 1:] = np.ascontiguousarray(remainders[:, width:]).view(np.uint64).reshape(len(used), limbs - 1)
    counts = parts[3][used].astype(np.int64)
    counts[counts == 255] = parts[4].view(np.uint64).astype(np.int64)
    return keys, counts


def merged(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of filters of one range, in order, with the sums of their counts: two and two, so that sorted lists meet lists of their size."""
    lists = [decode(data) for data in filters]
    while len(lists) > 1:
        pairs = [lists[k : k + 2] for k in range(0, len(lists), 2)]
        lists = [added(*(np.concatenate(part) for part in zip(*pair))) if len(pair) > 1 else pair[0] for pair in pairs]
    return lists[0]
