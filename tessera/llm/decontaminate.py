"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are folded: letters and digits lower-cased, every other run one separator.
An item of up to ``LONG`` folded characters is sought as a whole, a longer one in overlapping segments of
``SEGMENT``. Besides, every item of ``SHORT`` or more is cut into segments of ``SHORT`` at steps of ``STEP``, so
any verbatim passage of ``PASSAGE`` folded characters (some 13 words) holds a whole segment and is found; one
with edits is found if a segment in it is within its budget. Shorter passages of an item, other than a whole
short item, are not sought. For a segment of length L the edit budget is
``e = floor(RATE * L)``; a region within it shares at least ``L - q + 1 - q*e`` q-grams. Hits are counted
in overlapping diagonal bands of width ``2(e+1)``, so every region within the budget lies wholly in one
band; regions that meet the bound are verified by an alignment of the segment along the diagonals of that band.

Nulls, empty texts and items without ``Q`` folded characters give no hit, nor does an empty table. Repeated documents are
each reported, repeated items once; of equal edits the first region in the text is told. Rows without id are not searched or
sought; other columns are ignored. Whole texts are read, some ``CHUNK`` bytes at a time, a longer one alone. The benchmark is
the stated query set: it is split into blocks of about ``BLOCK_BYTES`` of text, and every block is held against all
documents; a worker never holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.codepoints import decode, folded
from tessera.llm.shared import prepare, tidy
from tessera.llm.textops import chunks, mix

Q = 8
RATE = 0.08
LONG, SEGMENT, STRIDE = 160, 120, 60
SHORT, STEP = 64, 16
PASSAGE = SHORT + STEP - 1
BLOCK_BYTES = 4 << 20
#: Bytes of text searched at once; the hits of a chunk are the largest thing a worker holds.
CHUNK = 1 << 18
#: Pairs of document and segment up to which hits are counted in a dense array.
DENSE = 1 << 23

_W = (mix(np.arange(1, Q + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)


def grams(stream: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at every position of a folded stream."""
    n = len(stream) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = stream.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out += wide[k : k + n] * _W[k]
    return mix(out)


def segments(stream: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts of one folded item that are searched for on their own."""
    n = len(stream)
    if n < Q:
        return []
    if n <= LONG:
        out = [(0, n)]
    else:
        out = [(s, s + SEGMENT) for s in (*range(0, n - SEGMENT, STRIDE), n - SEGMENT)]
    if n > SHORT:
        out += [(s, s + SHORT) for s in (*range(0, n - SHORT, STEP), n - SHORT)]
    return out


class Index:
    """q-gram index of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.text, keys, of, place, seg, at, n = [], [], [], [], [], [], [], 0
        for k, (item_id, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            cps, off = decode(raw, np.array([0, len(raw)]))
            stream, _, _ = folded(cps, off, "alnum")
            stream = stream[1:-1] if len(stream) > 2 and stream[-1] == 0 else stream[1:]
            g = grams(stream)
            keys.append(g)
            of.append(np.full(len(g), k))
            for a, b in segments(stream):
                m = b - a - Q + 1
                place.append(n + np.arange(a, a + m))
                seg.append(np.full(m, len(self.item)))
                at.append(np.arange(m))
                self.item.append(item_id)
                self.text.append(stream[a:b])
            n += len(g)
        join = lambda parts, kind: (np.concatenate(parts) if parts else np.zeros(0)).astype(kind)
        keys, self.of, place = join(keys, np.uint64), join(of, np.int64), join(place, np.int64)
        # the items' q-grams by hash, and the segments over each of them
        self.place = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[self.place], return_index=True, return_counts=True)
        order = np.argsort(place, kind="stable")
        self.seg, self.at = join(seg, np.int64)[order], join(at, np.int64)[order]
        self.over = np.searchsorted(place[order], np.arange(n + 1))
        self.length = np.array([len(t) for t in self.text], dtype=np.int64)
        self.budget = np.floor(RATE * self.length).astype(np.int64)
        self.need = np.maximum(1, self.length - Q + 1 - Q * self.budget)
        self.least = np.full(len(items), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.of[place[order]], self.need[self.seg])
        self.reach = int((self.length + 2 * self.budget).max(initial=1))
        # one bit in 16 is set at most, and the table fits a processor's cache for most benchmarks
        self.bits = max(16, int(np.ceil(np.log2(len(self.keys) * 16 + 1))))
        marked = np.unique(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.filter = np.zeros(1 << (self.bits - 3), np.uint8)
        np.bitwise_or.at(self.filter, marked >> 3, np.uint8(1) << (marked & 7).astype(np.uint8))

    def hits(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the stream, place among the items' q-grams) of every shared q-gram."""
        g = grams(stream)
        at = (g >> np.uint64(64 - self.bits)).astype(np.int64)
        pos = np.flatnonzero(self.filter[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1))
        g = g[pos]
        k = np.searchsorted(self.keys, g)
        k[k == len(self.keys)] = 0
        same = self.keys[k] == g
        pos, k = pos[same], k[same]
        which, flat = _spread(self.first[k], self.count[k])
        return pos[which], self.place[flat]

    def near(self, pos: np.ndarray, place: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which hits have, within the reach of a region, as many others of their item as its easiest segment needs."""
        if not len(pos):
            return np.zeros(0, bool)
        item = self.of[place]
        block = pos // self.reach
        # no region is longer than a block, so each lies in two neighbouring ones
        key = (owner * len(self.least) + item) * (int(block.max()) + 2) + block
        found, which, n = np.unique(key, return_inverse=True, return_counts=True)
        side = np.zeros(len(found), np.int64)
        touch = np.flatnonzero(found[1:] == found[:-1] + 1)
        side[touch] = n[touch + 1]
        side[touch + 1] = np.maximum(side[touch + 1], n[touch])
        return (n + side)[which] >= self.least[item]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, first[k] + i) for every k and every i below count[k]."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else which


def banded(pattern: np.ndarray, text: np.ndarray, budget: int, first: int | None = None, last: int | None = None) -> int:
    """Least edits that turn ``pattern`` into some substring of ``text``, or budget + 1 if more.

    Only cells of the diagonals (position in the text less that in the pattern) from first to last are computed.
    """
    m, n, far = len(pattern), len(text), 1 << 30
    first, last = (-m if first is None else first), (n if last is None else last)
    step = np.arange(last - first + 1)
    ahead = max(0, 1 - first)
    padded = np.concatenate((np.full(ahead, 1 << 31, np.int64), text.astype(np.int64), np.full(max(0, m + last - n), 1 << 31, np.int64)))
    row = np.where((first + step >= 0) & (first + step <= n), 0, far)
    for i in range(1, m + 1):
        j = i + first + step
        new = row + (padded[i + first - 1 + ahead : i + first + ahead + len(step) - 1] != pattern[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[j == 0] = i
        new[j < 0] = far
        row = np.minimum.accumulate(new - step) + step
        row[j > n] = far
        if row.min() > budget:
            return budget + 1
    return min(int(row.min()), budget + 1)


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, buf, off in chunks(batch.column("text"), CHUNK):
                if len(index.keys):
                    yield from _regions(index, doc[a:b], buf, off)

    return run


def _times(values: np.ndarray, end: int) -> np.ndarray:
    """How often each value, from 0 to end - 1, occurs among all."""
    if end <= DENSE:
        return np.bincount(values, minlength=end)[values]
    _, which, n = np.unique(values, return_inverse=True, return_counts=True)
    return n[which]


def _regions(index: Index, doc: np.ndarray, buf: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
    cps, off = decode(buf, off)
    stream, off, src = folded(cps, off, "alnum")
    pos, place = index.hits(stream)
    owner = np.searchsorted(off, pos, side="right") - 1
    keep = pos + Q <= off[owner + 1]
    pos, place, owner = pos[keep], place[keep], owner[keep]
    keep = index.near(pos, place, owner)
    pos, place, owner = pos[keep], place[keep], owner[keep]
    which, flat = _spread(index.over[place], index.over[place + 1] - index.over[place])
    pos, owner, seg, at = pos[which], owner[which], index.seg[flat], index.at[flat]
    # a segment with fewer hits in the whole document than one region needs is out
    pair = owner * len(index.item) + seg
    keep = _times(pair, len(doc) * len(index.item)) >= index.need[seg]
    pos, seg, at, owner, pair = pos[keep], seg[keep], at[keep], owner[keep], pair[keep]
    if not len(pos):
        return
    width = index.budget[seg] + 1
    half = (pos - at - off[owner] + index.length[seg] + 2) // width  # half-bands, numbered from 0
    order = np.lexsort((at, half, pair))
    p, h, t = pair[order], half[order], at[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (h[1:] != h[:-1])
    fresh = new.copy()
    fresh[1:] |= t[1:] != t[:-1]
    first = np.flatnonzero(new)
    count = np.add.reduceat(fresh.astype(np.int64), first)
    p, h = p[first], h[first]
    # band b is half-bands b and b + 1, so neighbouring bands overlap by one
    after = np.zeros(len(p), np.int64)
    joined = (p[1:] == p[:-1]) & (h[1:] == h[:-1] + 1)
    after[:-1][joined] = count[1:][joined]
    alone = np.ones(len(p), bool)  # the band that ends with this half-band, where no half-band precedes it
    alone[1:] = ~joined
    found = [(int(x), int(y)) for x, y, c in zip(p, h, count + after, strict=True) if c >= index.need[x % len(index.item)]]
    found += [(int(x), int(y) - 1) for x, y, c in zip(p[alone], h[alone], count[alone], strict=True) if c >= index.need[x % len(index.item)]]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for x, b in found:
        o, s = divmod(x, len(index.item))
        e, length, key = int(index.budget[s]), int(index.length[s]), (o, index.item[s])
        if best.get(key, (e + 1,))[0] == 0:
            continue
        lo = int(off[o]) + b * (e + 1) - (length + 2)
        hi = min(lo + 2 * (e + 1) + length + e, int(off[o + 1]))
        lo = max(lo, int(off[o]))
        region = stream[lo:hi]
        exact = region.tobytes().find(index.text[s].tobytes()) % 4 == 0  # -1 is no find; only whole characters count
        first = b * (e + 1) - (length + 2) - (lo - int(off[o]))
        edits = 0 if exact else banded(index.text[s], region, e, first, first + 2 * (e + 1) - 1)
        if edits <= e and edits < best.get(key, (e + 1,))[0]:
            best[key] = (edits, int(src[lo] - src[off[o]]), int(src[hi - 1] - src[off[o]]))
    keys = sorted(best)
    if keys:
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(doc[k[0]]) for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([best[k][i] for k in keys], pa.int64()) for i in range(3))],
            ["doc_id", "item_id", "edits", "region_start", "region_end"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, region_start, region_end: documents holding a passage of an item.

    One row for each document row and item; edits is the least of the item's segments, the region its
    place in code points.
    """
    prepare(docs.sparkSession)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    out = None
    for block in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()
        index = Index([(r.item_id, r.text) for r in mine])
        found = docs.mapInArrow(tidy(_search(index)), "doc_id long, item_id long, edits long, region_start long, region_end long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns kept, that hold no passage of the benchmark."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
