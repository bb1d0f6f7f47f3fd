"""Vectorised text primitives over Arrow string batches: word spans, word hashes, shingle sets.

Every function works on whole texts. A null text is read as an empty one. Words are the runs
of bytes outside 0x20 and 0x09-0x0D; lower-casing touches A-Z only, as the contracts say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a worker; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

np.seterr(over="ignore")  # 64-bit hash arithmetic wraps on purpose

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    out = _powers["p"][:n], _powers["i"][:n]
    if n > 8 * CHUNK_BYTES:  # do not keep tables sized by one huge document
        _powers.clear()
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``size`` bytes."""
    buf, off = buffers(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = int(np.searchsorted(off, off[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, buf[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each document the index of its first word."""
    n = len(buf)
    ink = np.zeros(n + 2, dtype=bool)
    np.logical_not(SPACE[buf], out=ink[1:-1])
    begin = ink[1:-1] & ~ink[:-2]
    close = ink[1:-1] & ~ink[2:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = ink[1:-1][edges]
    close[edges - 1] = ink[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    n = len(buf)
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's word shingles, lower-cased on A-Z.

    A document of fewer words has one shingle, the whole sequence; without words the set is empty.
    """
    low = LOWER[buf]
    starts, ends, first = word_spans(low, off)
    words = span_hashes(low, starts, ends)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for k in range(width):
            rolled += words[k : len(words) - width + 1 + k] * (_WEIGHTS[k % 5] + np.uint64(2 * (k // 5)))
        rolled = mix(rolled)
    out = []
    for d in range(len(off) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = words[a:b]
            key = (short * (_WEIGHTS[np.arange(b - a) % 5] + (2 * (np.arange(b - a) // 5)).astype(np.uint64))).sum(dtype=np.uint64)
            out.append(mix(np.array([key + np.uint64(b - a) * _M2], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def split_by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts rows by bucket, with the bucket numbers present and their bounds."""
    bucket = ((keys >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    there, begin = np.unique(bucket[order], return_index=True)
    return order, there, np.append(begin, len(order))
