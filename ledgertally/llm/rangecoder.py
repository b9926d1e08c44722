"""An adaptive context-mixing range coder for token ids below 65,536, many blocks side by side in numpy.

Each block of ids is coded on its own, from a model as at the start, so blocks can be decoded in any order; all blocks of a call go step by step
together, one array operation for all of them. For the next id there is a candidate: what came last after the same two ids, else
what came last after the same one. Whether it is right is one binary decision, whose probability mixes the records of the order-2 context, of the
order-1 context and of the block (order 0) in the logistic domain, with weights that learn. An id that is not the candidate
is coded by adaptive order-0 frequencies of its two bytes. All of it is integer arithmetic.

A block: number of ids, number of 16-bit words, CRC-32 of the ids as little-endian unsigned 32-bit integers; then the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
_SLOTS = 1 << 11
_LEARN = 32  # steps between new sums of byte frequencies
_STEP, _MOST = 24, 1 << 14
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
_WORD = np.uint64(16)

_squash = np.clip(np.round(65536 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 64, 65472).astype(np.int64)
_stretch = np.clip(np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))), -2047, 2047).astype(np.int64)


class _Lanes:
    """The models of blocks side by side, and the coder's interval of each."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64) * _SLOTS
        self.after2, self.after1 = (np.full(lanes * _SLOTS, -1, np.int32) for _ in range(2))
        self.right2, self.right1 = (np.full(lanes * _SLOTS, 1 << 14, np.int32) for _ in range(2))
        self.right0 = np.full(lanes, 1 << 12, np.int64)
        self.weights = np.full((3, lanes), 1 << 15, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.counts = np.ones((2, lanes, 256), np.int32)
        self.sums = np.zeros((2, lanes, 257), np.int32)
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.rows = np.arange(lanes)
        self.sum_up()

    def only(self, lanes: int) -> None:
        """Drops the lanes behind the first ones."""
        for name in ("base", "right0", "last", "before", "low", "range", "rows"):
            setattr(self, name, getattr(self, name)[:lanes])
        self.weights, self.counts, self.sums = self.weights[:, :lanes], self.counts[:, :lanes], self.sums[:, :lanes]

    def sum_up(self) -> None:
        np.cumsum(self.counts, axis=2, out=self.sums[:, :, 1:])
        full = self.sums[:, :, -1] > _MOST
        if full.any():
            self.counts[full] = (self.counts[full] + 1) >> 1
            np.cumsum(self.counts, axis=2, out=self.sums[:, :, 1:])

    def guess(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidates, and the bounds below which the interval says that they are right."""
        self.at2 = self.base + ((self.last * 40503 + self.before * 30011 + (self.before >> 5)) & (_SLOTS - 1))
        self.at1 = self.base + ((self.last * 40503 >> 3) & (_SLOTS - 1))
        candidate, other = self.after2[self.at2], self.after1[self.at1]
        self.r2, self.r1 = self.right2[self.at2], self.right1[self.at1]
        self.x = _stretch[np.stack([self.r2, self.r1, self.right0]) >> 4]
        dot = np.einsum("ij,ij->j", self.weights, self.x) >> 16
        self.p = _squash[np.clip(dot, -2048, 2047) + 2048]
        return np.where(candidate < 0, other, candidate), (self.range >> _WORD) * self.p.astype(np.uint64)

    def learn(self, ids: np.ndarray, hit: np.ndarray, missed: np.ndarray) -> None:
        truth = hit.astype(np.int64) << 16
        self.weights += (self.x * (truth - self.p)) >> 13
        truth = np.minimum(truth, 65535)
        self.right2[self.at2] = self.r2 + ((truth - self.r2) >> 2)
        self.right1[self.at1] = self.r1 + ((truth - self.r1) >> 3)
        self.right0 += (truth - self.right0) >> 5
        self.after2[self.at2] = ids
        self.after1[self.at1] = ids
        literal = ids[missed]
        self.counts[0, missed, literal >> 8] += _STEP
        self.counts[1, missed, literal & 255] += _STEP
        self.before, self.last = self.last, ids

    def full(self, at: np.ndarray | None) -> np.ndarray:
        """The lanes (of those) whose interval needs more words; one that straddles a word's border while small is cut at the border."""
        low, size = (self.low, self.range) if at is None else (self.low[at], self.range[at])
        same = (low ^ (low + size)) < _TOP
        small = size < _BOTTOM
        go = np.flatnonzero(same | small)
        cut = go[~same[go]]
        lanes = go if at is None else at[go]
        if len(cut):
            size[cut] = (~low[cut] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
            if at is not None:
                self.range[at[cut]] = size[cut]
        return lanes

    def shift(self, lanes: np.ndarray) -> None:
        self.low[lanes] <<= _WORD
        self.range[lanes] <<= _WORD


def encode(ids: np.ndarray) -> bytes:
    """The blocks of an array of ids, one after the other."""
    ids = np.ascontiguousarray(ids, np.int64)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
        raise ValueError("ids from 0 to 65535 are needed")
    lanes = -(-len(ids) // BLOCK)
    sizes = np.full(lanes, BLOCK)
    if lanes:
        sizes[-1] = len(ids) - (lanes - 1) * BLOCK
    padded = np.zeros(lanes * BLOCK, np.int64)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    out, used = np.zeros((lanes, 3 * BLOCK + 16), np.uint16), np.zeros(lanes, np.int64)
    state, live, low = _Lanes(lanes), lanes, np.zeros(lanes, np.uint64)
    with np.errstate(over="ignore"):
        for step in range(int(sizes[0]) if lanes else 0):
            if live == lanes and step >= sizes[-1]:
                live -= 1
                low[live] = state.low[live]
                state.only(live)
            now = columns[step, :live]
            candidate, bound = state.guess()
            hit = now == candidate
            state.low += np.where(hit, np.uint64(0), bound)
            state.range = np.where(hit, bound, state.range - bound)
            missed = np.flatnonzero(~hit)
            for byte, value in enumerate((now[missed] >> 8, now[missed] & 255)):
                sums = state.sums[byte]
                part = state.range[missed] // sums[missed, 256].astype(np.uint64)
                begin = sums[missed, value]
                state.low[missed] += part * begin.astype(np.uint64)
                state.range[missed] = part * (sums[missed, value + 1] - begin).astype(np.uint64)
            go = state.full(None)
            while len(go):
                out[go, used[go]] = (state.low[go] >> _TOP_SHIFT).astype(np.uint16)
                used[go] += 1
                state.shift(go)
                go = state.full(go)
            state.learn(now, hit, missed)
            if step % _LEARN == _LEARN - 1:
                state.sum_up()
    low[:live] = state.low
    for word in range(4):
        out[np.arange(lanes), used] = (low >> np.uint64(48 - 16 * word)).astype(np.uint16)
        used += 1
    parts, small = [], ids.astype("<u4")
    for lane in range(lanes):
        own = small[lane * BLOCK : lane * BLOCK + sizes[lane]]
        parts.append(struct.pack("<III", sizes[lane], used[lane], zlib.crc32(own.tobytes())))
        parts.append(out[lane, : used[lane]].astype("<u2").tobytes())
    return b"".join(parts)


_TOP_SHIFT = np.uint64(48)


def decode(data: bytes) -> np.ndarray:
    """The ids of blocks that `encode` wrote; an error if a checksum is wrong."""
    sizes, words, checks, at = [], [], [], 0
    while at < len(data):
        n, used, crc = struct.unpack_from("<III", data, at)
        if n > BLOCK or at + 12 + 2 * used > len(data):
            raise ValueError("a block is damaged")
        sizes.append(n)
        checks.append(crc)
        words.append(np.frombuffer(data, "<u2", used, at + 12))
        at += 12 + 2 * used
    lanes = len(sizes)
    if not lanes:
        return np.zeros(0, np.int64)
    if any(n != BLOCK for n in sizes[:-1]):
        raise ValueError("a block is damaged")
    coded = np.zeros((lanes, max(map(len, words)) + 8), np.uint64)
    for lane, own in enumerate(words):
        coded[lane, : len(own)] = own
    code, used = np.zeros(lanes, np.uint64), np.full(lanes, 4)
    for word in range(4):
        code = (code << _WORD) | coded[:, word]
    columns = np.zeros((BLOCK, lanes), np.int64)
    state, live = _Lanes(lanes), lanes
    most = coded.shape[1] - 1
    with np.errstate(over="ignore"):
        for step in range(sizes[0]):
            if live == lanes and step >= sizes[-1]:
                live -= 1
                state.only(live)
                code, used = code[:live], used[:live]
            candidate, bound = state.guess()
            hit = code - state.low < bound
            state.low += np.where(hit, np.uint64(0), bound)
            state.range = np.where(hit, bound, state.range - bound)
            now = np.where(hit, candidate, 0).astype(np.int64)
            missed = np.flatnonzero(~hit)
            for byte in range(2):
                sums = state.sums[byte]
                total = sums[missed, 256].astype(np.uint64)
                part = state.range[missed] // total
                value = np.minimum((code[missed] - state.low[missed]) // np.maximum(part, np.uint64(1)), total - np.uint64(1)).astype(np.int32)
                digit = np.zeros(len(missed), np.int64)
                for half in (128, 64, 32, 16, 8, 4, 2, 1):
                    digit += np.where(sums[missed, digit + half] <= value, half, 0)
                begin = sums[missed, digit]
                state.low[missed] += part * begin.astype(np.uint64)
                state.range[missed] = part * (sums[missed, digit + 1] - begin).astype(np.uint64)
                now[missed] = now[missed] * 256 + digit
            go = state.full(None)
            while len(go):
                code[go] = (code[go] << _WORD) | coded[go, np.minimum(used[go], most)]
                used[go] += 1
                state.shift(go)
                go = state.full(go)
            columns[step, :live] = now
            state.learn(now, hit, missed)
            if step % _LEARN == _LEARN - 1:
                state.sum_up()
    ids = np.ascontiguousarray(columns.T).reshape(-1)[: (lanes - 1) * BLOCK + sizes[-1]]
    small = ids.astype("<u4")
    for lane, check in enumerate(checks):
        if zlib.crc32(small[lane * BLOCK : lane * BLOCK + sizes[lane]].tobytes()) != check:
            raise ValueError("a block's checksum is wrong")
    return ids
