"""Case folding and letter classes by code point, as lookup tables over numpy arrays."""

from __future__ import annotations

import numpy as np

_tables: dict[str, np.ndarray] = {}


def _build() -> None:
    n = 0x110000
    lower, letter, alnum = np.arange(n, dtype=np.uint32), np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        c = chr(i)
        if c.isalpha():
            letter[i] = alnum[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        elif c.isalnum():
            alnum[i] = True
    _tables.update(lower=lower, letter=letter, alnum=alnum)


def table(name: str) -> np.ndarray:
    """``lower`` (code point to its lower case), ``letter`` or ``alnum`` (membership)."""
    if not _tables:
        _build()
    return _tables[name]


def decode(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, with document offsets counted in code points."""
    cps = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    count = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return cps, count[off]


def folded(cps: np.ndarray, off: np.ndarray, keep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased ``keep`` characters, every run of others one 0; offsets, and source positions.

    Each document begins and ends with a 0 that is not shared with its neighbours.
    """
    ink = table(keep)[cps]
    low = np.where(ink, table("lower")[cps], 0).astype(np.uint32)
    n_docs = len(off) - 1
    # a separator before and after each document
    size = np.diff(off) + 2
    new_off = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(new_off[-1], np.uint32)
    src = np.zeros(new_off[-1], np.int64)
    place = np.arange(len(cps)) + 1 + 2 * np.repeat(np.arange(n_docs), np.diff(off))
    out[place] = low
    src[place] = np.arange(len(cps))
    src[new_off[1:] - 1] = off[1:]
    src[new_off[:-1]] = off[:-1]
    edge = np.zeros(len(out), bool)
    edge[new_off[:-1]] = True
    keep_it = (out != 0) | edge | np.concatenate(([True], out[:-1] != 0))
    kept = np.concatenate(([0], np.cumsum(keep_it)))
    return out[keep_it], kept[new_off], src[keep_it]
