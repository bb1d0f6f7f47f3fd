"""Directly addressable codes: ids cut into byte chunks by level, with continuation bitmaps and ranks.

Level 0 holds the lowest byte of every id, level k the k-th byte of those that have one. A bitmap beside each
level tells which of its entries go on, and a rank directory counts the set bits before every 512th, so entry i
of one level finds its place in the next by one rank, and any id is read without decoding a block.

Layout, little-endian: b"DAC1", u32 levels, u64 ids; then for each level u64 entries, its bytes, and but for the
last level the bitmap (padded to 8 bytes) and u64 ranks.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
RANK_BITS = 512


def encode(ids: np.ndarray) -> bytes:
    left = ids.astype(np.uint64)
    levels = []
    while True:
        more = left >= 256
        levels.append(((left & np.uint64(255)).astype(np.uint8), more))
        if not more.any():
            break
        left = left[more] >> np.uint64(8)
    out = [MAGIC, struct.pack("<IQ", len(levels), len(ids))]
    for k, (low, more) in enumerate(levels):
        out += [struct.pack("<Q", len(low)), low.tobytes()]
        if k < len(levels) - 1:
            bits = np.packbits(more, bitorder="little")
            bits = np.append(bits, np.zeros(-len(bits) % 8, np.uint8))
            count = np.add.reduceat(more.astype(np.uint64), np.arange(0, len(more), RANK_BITS))
            out += [bits.tobytes(), np.concatenate(([0], np.cumsum(count)[:-1])).astype("<u8").tobytes()]
    return b"".join(out)


class Reader:
    """Random access and sequential reading of one encoded run of ids."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a DAC file")
        n_levels, self.n = struct.unpack_from("<IQ", view, 4)
        at, self.levels = 16, []
        for k in range(n_levels):
            (m,) = struct.unpack_from("<Q", view, at)
            low = np.frombuffer(view, np.uint8, m, at + 8)
            at += 8 + m
            bits = ranks = None
            if k < n_levels - 1:
                size = -(-(-(-m // 8)) // 8) * 8
                bits = np.frombuffer(view, np.uint8, size, at)
                at += size
                ranks = np.frombuffer(view, "<u8", -(-m // RANK_BITS), at)
                at += 8 * len(ranks)
            self.levels.append((low, bits, ranks))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            span = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(ranks[block]) + int(span.sum())
        return value

    def _rank(self, level: int, i: int) -> int:
        """Entries of a level before ``i`` that go on."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BITS
        if block == len(ranks):  # the end of a level whose last block is full
            block -= 1
        part = bits[block * RANK_BITS // 8 : -(-i // 8)]
        return int(ranks[block]) + int(np.unpackbits(part, count=i - block * RANK_BITS, bitorder="little").sum()) if i else 0

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1, reading no other entry: those that go on are a run of the next level too."""
        if not 0 <= start <= end <= self.n:
            raise IndexError((start, end))
        runs = []
        for k, (low, bits, _) in enumerate(self.levels):
            if start == end:
                break
            value, more = low[start:end].astype(np.uint32), None
            if bits is not None:
                more = np.unpackbits(bits[start >> 3 : -(-end // 8)], bitorder="little")[start & 7 :][: end - start].astype(bool)
                start = self._rank(k, start)
                end = start + int(more.sum())
            runs.append((value, more))
            if more is None:
                break
        below = np.zeros(0, np.uint32)
        for value, more in reversed(runs):
            if more is not None:
                value[more] |= below << np.uint32(8)
            below = value
        return below

    def all(self) -> np.ndarray:
        below = None
        for low, bits, _ in reversed(self.levels):
            value = low.astype(np.uint32)
            if bits is not None:
                more = np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)
                value[more] |= below << np.uint32(8)
            below = value
        return below if below is not None else np.zeros(0, np.uint32)
