"""Language-model scoring by online logistic context mixing.

Every token is coded in binary decisions along a Huffman path over symbols: the ``WORDS`` most frequent words, the
end token, and ``CLASSES`` classes of all other words by their last letters. Each decision is predicted by
several hashed-context bit predictors (no context, previous symbol, previous two, last frequent word) whose
counts come from all training documents; their stretched probabilities are combined by weights that a gate
picks by the predictors' confidence, learnt online as the training text goes by, and the mixed probability is
refined by an adaptive map of (decision, probability) to what really happened. Inside a class a word costs its
smoothed share of the class; one more count is the escape to words that were never seen, which are spelt by
bytes, each given the one before it. That share is mixed with what followed the token before it: of all training
tokens of the class after that token, ``n`` in all and ``d`` distinct, a word that stood there ``c`` times gets
``(c + d * share) / (n + d)``, so the weight of the share falls as its context gathers counts. These counts are a
table over the whole training text, in buckets by context; it grows with the input and is never gathered. The bits
of a text are those of its tokens; ``score`` is their log10 probability, ``bits_per_byte`` the total over the
text's bytes.

The vocabulary is counted in hash buckets and never gathered whole: at most ``TOP`` words reach the workers. Tokens
beyond them go through their word's bucket, which tells their counts, and from there to the bucket of their context, so
what followed a token is counted for every word. All occurrences of a context lie in one bucket, 12 bytes each; what
they add to a document goes on to the document's bucket. Bit counts have a fixed number of slots and are summed over training
shards, ``FAN`` at a time. Shards are sets of documents by a hash of their id, in order of id, so the model does not
depend on how the table is split; there are at most ``MAX_SHARDS``.

Null and empty texts are one end token. Rows of one doc_id are one document, the least non-null text; rows without doc_id
are left out, as are other columns. With no training document every probability falls back to its prior.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Workspace, partitions, prepare, trim
from tessera.llm.textops import LOWER, chunks, mix, span_hashes, split_by_bucket, word_spans

WORDS = 1024
CLASSES = 128
TOP = 2_000_000
SLOT_BITS = 20
CONTEXTS = 4
MARKERS = 64
GATES = 16
STEPS = 24
PARTS = 16
#: Documents of a training shard, where that gives no more than MAX_SHARDS; states that one task adds up.
SHARD_DOCS, MAX_SHARDS, FAN = 8192, 16_384, 32
#: Bytes of text scored at once: a token has some ten decisions, each with several arrays.
SCORE_BYTES = 1 << 19
#: Decisions handled at once, so that their arrays stay in a core's cache.
BLOCK = 1 << 15

_END = np.array([0xE14D], dtype=np.uint64)
END_KEY = int(mix(_END)[0])


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token, ends included, and each document's first token."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, off)
    keys = span_hashes(low, starts, ends)
    last = low[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, low[ends - 2] if len(ends) else 0, 0).astype(np.uint64)
    third = np.where(ends - starts > 2, low[np.maximum(ends - 3, 0)] if len(ends) else 0, 0).astype(np.uint64)
    kind = (mix(last | before << np.uint64(8) | third << np.uint64(16)) % np.uint64(CLASSES)).astype(np.uint8)
    n_docs = len(off) - 1
    at = np.arange(len(keys)) + np.repeat(np.arange(n_docs), np.diff(first))
    all_keys = np.full(len(keys) + n_docs, END_KEY, np.uint64)
    all_kind = np.zeros(len(keys) + n_docs, np.uint8)
    all_keys[at], all_kind[at] = keys, kind
    return all_keys, all_kind, first + np.arange(n_docs + 1)


def spelt(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log10 probability of every token's bytes (0 for ends), by a table of a byte and the next one; 256 is a word's edge."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, off)
    n_docs = len(off) - 1
    out = np.zeros(len(starts) + n_docs)
    if len(starts):
        before = np.concatenate(([256], low[:-1]))
        before[starts] = 256
        upto = np.concatenate(([0], np.cumsum(table[before, low])))
        out[np.arange(len(starts)) + np.repeat(np.arange(n_docs), np.diff(first))] = upto[ends] - upto[starts] + table[low[ends - 1], 256]
    return out


def _spelling(buf: np.ndarray, off: np.ndarray, rare: np.ndarray, total: np.ndarray) -> None:
    """Adds the byte pairs of the words whose tokens are marked as rare."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, off)
    mark = rare[np.arange(len(starts)) + np.repeat(np.arange(len(off) - 1), np.diff(first))]
    starts, ends = starts[mark], ends[mark]
    if len(starts):
        inside = np.zeros(len(low) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        before = np.concatenate(([256], low[:-1])).astype(np.int64)
        before[starts] = 256
        total += np.bincount(np.concatenate((before[at] * 257 + low[at], low[ends - 1].astype(np.int64) * 257 + 256)), minlength=257 * 257)


def _vocabulary(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> pa.RecordBatch:
            keys, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
            uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=n).astype(np.int64)
            order, there, bound = split_by_bucket(uniq, n_buckets)
            uniq, kind, total = uniq[order], kind[first][order], total[order]
            cut = [(x.tobytes(), y.tobytes(), z.tobytes()) for x, y, z in ((uniq[a:b], kind[a:b], total[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(pa.array([c[i] for c in cut], pa.binary()) for i in range(3))], ["bucket", "keys", "kinds", "counts"])

        held, size = [], 0
        for batch in batches:
            for _, _, buf, off in chunks(batch.column("text")):
                keys, kind, _ = tokens(buf, off)
                uniq, first, n = np.unique(keys, return_index=True, return_counts=True)
                held.append((uniq, kind[first], n))
                size += len(uniq)
                if size > 3_000_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _merged(top: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket of the vocabulary: its words, their counts, the most frequent of them, and sums over it."""
        join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        keys, kinds, n = join("keys", np.uint64), join("kinds", np.uint8), join("counts", np.int64)
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        n, kinds = np.bincount(inverse, weights=n).astype(np.int64), kinds[first]
        best = np.sort(np.lexsort((keys, -n))[:top])
        weight = np.bincount(kinds, weights=n + 1, minlength=CLASSES).astype(np.int64)
        cells = [table.column("bucket")[0].as_py(), keys.tobytes(), n.tobytes(), keys[best].tobytes(), kinds[best].tobytes(), n[best].tobytes(), int(n.sum()), len(n), weight.tobytes()]
        return pa.table([pa.array([c], f.type) for c, f in zip(cells, _VOCAB_ARROW, strict=True)], schema=_VOCAB_ARROW)

    return run


_VOCAB_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("top_keys", pa.binary()), ("top_kinds", pa.binary()), ("top_counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("weight", pa.binary())])
_VOCAB = "bucket int, keys binary, counts binary, top_keys binary, top_kinds binary, top_counts binary, n long, v long, weight binary"


class Code:
    """Symbols, their Huffman paths and the class masses."""

    def __init__(self, keys: np.ndarray, kinds: np.ndarray, counts: np.ndarray, class_weight: np.ndarray):
        order = np.lexsort((keys, -counts))
        order = order[keys[order] != np.uint64(END_KEY)][:WORDS]
        self.markers = min(MARKERS, len(order))
        by_key = np.argsort(keys[order], kind="stable")
        self.keys, self.rank = keys[order][by_key], by_key.astype(np.int64)
        n_words = len(order)
        self.n_words, self.end = n_words, n_words
        self.n_symbols = n_words + 1 + CLASSES
        inside = np.bincount(kinds[order], weights=counts[order] + 1, minlength=CLASSES).astype(np.int64)
        ended = int(counts[keys == np.uint64(END_KEY)].sum())
        left = class_weight - inside
        left[0] -= (ended + 1) if ended else 0  # the end token was counted in class 0
        self.mass = np.maximum(left, 0) + 1  # one more for all unknown words of the class
        freq = np.concatenate((counts[order], [ended], self.mass)).astype(np.int64) + 1
        heap = [(int(f), s, s) for s, f in enumerate(freq)]
        heapq.heapify(heap)
        parent, at = {}, self.n_symbols
        while len(heap) > 1:
            (f, _, a), (g, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b] = (at, 0), (at, 1)
            heapq.heappush(heap, (f + g, at, at))
            at += 1
        node, bit, first = [], [], [0]
        for s in range(self.n_symbols):
            path, x = [], s
            while x in parent:
                x, y = parent[x]
                path.append((x - self.n_symbols, y))
            node += [p for p, _ in reversed(path)]
            bit += [b for _, b in reversed(path)]
            first.append(len(node))
        self.node, self.bit, self.first = np.array(node, np.uint32), np.array(bit, bool), np.array(first)

    def symbols(self, keys: np.ndarray, kind: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.where(known, self.rank[at] if len(self.keys) else 0, self.end + 1 + kind.astype(np.int64))
        return np.where(keys == np.uint64(END_KEY), self.end, out)

    def events(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Token, decision and outcome of every binary event, and its slot in each predictor."""
        t, none = len(sym), self.n_symbols
        prev1, prev2 = np.full(t, none), np.full(t, none)
        prev1[1:], prev2[2:] = sym[:-1], sym[:-2]
        begin = first[:-1]
        prev1[begin] = none
        prev2[begin] = none
        second = begin + 1
        second = second[(second < first[1:])]
        prev2[second] = none
        mark = np.where(sym < self.markers, np.arange(t), -1)
        seen = np.full(t, -1)
        seen[1:] = np.maximum.accumulate(mark)[:-1]
        seen[seen < np.repeat(begin, np.diff(first))] = -1
        marker = np.where(seen >= 0, sym[np.maximum(seen, 0)], none)
        n = self.first[sym + 1] - self.first[sym]
        tok = np.repeat(np.arange(t), n)
        upto = np.concatenate(([0], np.cumsum(n)[:-1]))
        flat = np.arange(len(tok)) + np.repeat(self.first[sym] - upto, n)
        node, bit = self.node[flat], self.bit[flat]
        spread = node * np.uint32(0x9E3779B1)
        slots = [node]
        for k, c in enumerate((prev1, prev1 * np.int64(none + 1) + prev2, marker)):
            h = (c.astype(np.uint32) + np.uint32(1)) * np.uint32((0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)[k])
            e = (h ^ (h >> np.uint32(15)))[tok] + spread
            e *= np.uint32(0x2C1B3C6D)
            e ^= e >> np.uint32(15)
            e *= np.uint32(0x297A2D39)
            slots.append(e >> np.uint32(32 - SLOT_BITS))
        return tok, node, bit, slots


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)), dtype=np.float32)


def _level(n: np.ndarray) -> np.ndarray:
    """Confidence of a predictor in four steps."""
    return (n > 0).astype(np.uint8) + (n > 8) + (n > 100)


def _mixed(st: list[np.ndarray], gate: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = w[CONTEXTS].take(gate)
    for j, s in enumerate(st):
        z = z + w[j].take(gate) * s
    return np.clip(z, -12, 12)


def _step(z: np.ndarray) -> np.ndarray:
    return ((z + 12) * np.float32((STEPS - 1) / 24)).astype(np.int32)


class _Shard:
    """Counts, weights and refining map of one training shard, learnt in order."""

    def __init__(self, code: Code):
        self.code, self.seen, size = code, 0, 1 << SLOT_BITS
        self.n = np.zeros((CONTEXTS, size, 2), np.uint32)  # both outcomes of a slot lie side by side
        self.w = np.full((CONTEXTS + 1, GATES), 0.3, np.float32)
        self.w[CONTEXTS] = 0
        self.refine = np.zeros((2, code.n_symbols * STEPS), np.int64)
        self.spelling = np.zeros(257 * 257, np.int64)

    def learn(self, buf: np.ndarray, off: np.ndarray) -> None:
        n, w, code = self.n, self.w, self.code
        keys, kind, first = tokens(buf, off)
        sym = code.symbols(keys, kind)
        _spelling(buf, off, sym > code.end, self.spelling)
        _, node, bit, slots = code.events(sym, first)
        for a in range(0, len(bit), 1 << 18):  # weights and counts stay as they are within one
            end = min(a + (1 << 18), len(bit))
            up, down = np.zeros((CONTEXTS + 1, GATES)), np.zeros((CONTEXTS + 1, GATES))
            for part in (slice(x, min(x + BLOCK, end)) for x in range(a, end, BLOCK)):
                y, s = bit[part], [x[part] for x in slots]
                got = [n[j].view(np.uint64)[:, 0].take(s[j]).view(np.uint32).reshape(-1, 2).T for j in range(CONTEXTS)]
                st = [_stretch(c0, c1) for c0, c1 in got]
                gate = (_level(got[1][0] + got[1][1]) * 4 + _level(got[2][0] + got[2][1])).astype(np.intp)
                z = _mixed(st, gate, w)
                p = 1 / (1 + np.exp(-z))
                err, v = y - p, p * (1 - p)
                for j in range(CONTEXTS + 1):
                    x = st[j] if j < CONTEXTS else np.float32(1)
                    up[j] += np.bincount(gate, weights=err * x, minlength=GATES)
                    down[j] += np.bincount(gate, weights=v * x * x, minlength=GATES)
                cell = node[part].astype(np.int64) * STEPS + _step(z)
                np.add.at(self.refine[0], cell, 1)
                np.add.at(self.refine[1], cell[y], 1)
            w += (0.1 * up / (down + 50)).astype(np.float32)
            for j in range(CONTEXTS):
                np.add.at(n[j].reshape(-1), slots[j][a:end] * np.uint32(2) + bit[a:end], np.uint32(1))
            self.seen += end - a

    def state(self, shard: int) -> Iterator[pa.RecordBatch]:
        if self.seen:
            parts = self.n.reshape(CONTEXTS, PARTS, -1, 2)
            for k in range(PARTS):
                yield _state_row(k, shard, counts=parts[:, k].transpose(0, 2, 1).tobytes())
            yield _state_row(PARTS, shard, weights=self.w.astype(np.float64).tobytes(), refine=self.refine.tobytes(), spelling=self.spelling.tobytes(), seen=self.seen)


_STATE = "part int, shard int, counts binary, weights binary, refine binary, spelling binary, seen long"
_STATE_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((k, pa.binary()) for k in ("counts", "weights", "refine", "spelling")), ("seen", pa.int64())])


def _state_row(part: int, shard: int, counts: bytes | None = None, weights: bytes | None = None, refine: bytes | None = None, spelling: bytes | None = None, seen: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, shard, counts, weights, refine, spelling, seen), _STATE_ARROW, strict=True)], schema=_STATE_ARROW)


def _train(code: Code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        now, model = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edge = np.flatnonzero(np.diff(shards)) + 1
            for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(shards)], strict=True):
                if y > x and shards[x] != now:
                    if model:
                        yield from model.state(now)
                    now, model = int(shards[x]), _Shard(code)
                for _, _, buf, off in chunks(batch.column("text").slice(x, y - x)):
                    model.learn(buf, off)
        if model:
            yield from model.state(now)

    return run


def _add(table: pa.Table) -> pa.Table:
    """States of up to FAN shards, in order, as one."""
    table = table.sort_by("shard")
    part, shard = table.column("part")[0].as_py(), table.column("shard")[0].as_py() // FAN
    if part < PARTS:
        total = None
        for x in table.column("counts"):
            x = np.frombuffer(x.as_buffer(), np.uint32)
            total = x.astype(np.uint64) if total is None else total + x
        row = _state_row(part, shard, counts=np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes())
    else:
        seen = np.array(table.column("seen").to_pylist())
        w = sum(np.frombuffer(x, np.float64) * s for x, s in zip(table.column("weights").to_pylist(), seen, strict=True)) / seen.sum()
        add = lambda name: sum(np.frombuffer(x, np.int64) for x in table.column(name).to_pylist())
        row = _state_row(part, shard, weights=w.tobytes(), refine=add("refine").tobytes(), spelling=add("spelling").tobytes(), seen=int(seen.sum()))
    return pa.Table.from_batches([row])


class Model:
    """What scoring needs: stretched predictions and confidences by slot, weights, and the refining map."""

    def __init__(self, code: Code, rows: list):
        self.code = code
        n = np.zeros((CONTEXTS * 2, PARTS, (1 << SLOT_BITS) // PARTS), np.uint32)
        self.w = np.full((CONTEXTS + 1, GATES), 0.3, np.float32)
        self.w[CONTEXTS] = 0
        refine, spelling = np.zeros((2, code.n_symbols * STEPS)), np.zeros((257, 257))
        for r in rows:
            if r["part"] < PARTS:
                n[:, r["part"]] = np.frombuffer(r["counts"], np.uint32).reshape(CONTEXTS * 2, -1)
            else:
                self.w = np.frombuffer(r["weights"], np.float64).reshape(CONTEXTS + 1, GATES).astype(np.float32)
                refine = np.frombuffer(r["refine"], np.int64).reshape(2, -1).astype(float)
                spelling = np.frombuffer(r["spelling"], np.int64).reshape(257, 257)
        # half a count for every byte; an edge after an edge is an empty word, which is none
        shares = spelling + 0.5
        shares[256, 256] = 0
        self.spelling = np.log10(np.maximum(shares, 1e-300) / shares.sum(1, keepdims=True))
        n = n.reshape(CONTEXTS, 2, -1)
        self.st = [_stretch(n[j, 0], n[j, 1]) for j in range(CONTEXTS)]
        self.level = [_level(n[j].sum(0, dtype=np.uint64)) for j in (1, 2)]
        middle = (np.arange(STEPS) + 0.5) * 24 / (STEPS - 1) - 12
        prior = np.tile(1 / (1 + np.exp(-middle)), code.n_symbols)
        self.refine = ((refine[1] + 40 * prior) / (refine[0] + 40)).astype(np.float32)

    def log10(self, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token's symbol."""
        tok, node, bit, slots = self.code.events(sym, first)
        out = np.empty(len(bit), np.float32)
        for a in range(0, len(bit), BLOCK):
            part = slice(a, a + BLOCK)
            s = [x[part] for x in slots]
            gate = (self.level[0].take(s[1]) * 4 + self.level[1].take(s[2])).astype(np.intp)
            z = _mixed([self.st[j].take(s[j]) for j in range(CONTEXTS)], gate, self.w)
            p = 1 / (1 + np.exp(-z))
            p = (p + self.refine[node[part].astype(np.int64) * STEPS + _step(z)]) / 2
            out[part] = np.log(np.where(bit[part], p, 1 - p))
        return np.bincount(tok, weights=out, minlength=len(sym)) / np.log(10)


#: What is added up for a document: tokens, known ones, log10 counts, log10 probability, bytes.
NOTES = 5
_KEPT = "dest int, docs binary, notes binary, gains binary"
_SCORED = "ask int, docs binary, notes binary, asking binary, sizes binary, learnt binary, contexts binary, words binary, shares binary"
_BEYOND = "bucket int, docs binary, keys binary, spelt binary, contexts binary, masses binary, learnt binary"
_TOTAL = "doc_id long, n_tokens long, n_known long, counted double, score double, n_bytes long"
_TYPES = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
_KEPT_ARROW, _SCORED_ARROW, _BEYOND_ARROW, _TOTAL_ARROW = (pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in x.split(", ")]) for x in (_KEPT, _SCORED, _BEYOND, _TOTAL))


def _among(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's place in sorted ``known``, and whether it is there."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


def _cut(values: np.ndarray, bound: np.ndarray) -> list[bytes]:
    return [values[x:y].tobytes() for x, y in zip(bound[:-1], bound[1:], strict=True)]


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()])


def _dealt(ids: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts documents by bucket, with the bucket numbers present and their bounds."""
    bucket = (ids % n_buckets).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    there, begin = np.unique(bucket[order], return_index=True)
    return order, there, np.append(begin, len(order))


def _rows(schema: pa.Schema, **cells) -> pa.RecordBatch:
    """Rows of a schema with the given columns, null in the others."""
    m = len(next(iter(cells.values())))
    return pa.RecordBatch.from_arrays([pa.array(cells[f.name], f.type) if f.name in cells else pa.nulls(m, f.type) for f in schema], schema=schema)


def _noted(ids: np.ndarray, notes: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Notes (NOTES, documents) by the documents' bucket."""
    order, there, bound = _dealt(ids, n_buckets)
    return _rows(_SCORED_ARROW, ask=there, docs=_cut(ids[order].astype(np.int64), bound), notes=_cut(np.ascontiguousarray(notes.T[order]), bound))


def _contexts(keys: np.ndarray, kind: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The context of the tokens ``at``: the token before, in its document, and the own class."""
    before = np.concatenate((np.zeros(1, np.uint64), keys[:-1]))
    before[first[:-1]] = 0
    return mix(before[at] + (kind[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _asked(docs: np.ndarray, learnt: np.ndarray, context: np.ndarray, keys: np.ndarray, share: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Words and contexts, ordered by document, by the contexts' bucket, with runs of them by document.

    ``share`` is the log10 share of a word in its class, NaN for words not in the training text; contexts are told apart
    by 32 bits within a bucket, and words by 32 bits within a context.
    """
    order, there, bound = split_by_bucket(context, n_buckets)
    owner = docs[order]
    fresh = np.concatenate(([True], owner[1:] != owner[:-1]))
    fresh[bound[:-1]] = True
    starts = np.flatnonzero(fresh)
    edge = np.searchsorted(starts, bound)
    of_run = {"asking": owner[starts].astype(np.int64), "sizes": np.diff(np.append(starts, len(order))).astype(np.uint32), "learnt": learnt[order][starts].astype(np.uint8)}
    of_token = {"contexts": context[order].astype(np.uint32), "words": (keys[order] >> np.uint64(32)).astype(np.uint32), "shares": share[order].astype(np.float32)}
    return _rows(_SCORED_ARROW, ask=there, **{k: _cut(v, edge) for k, v in of_run.items()}, **{k: _cut(v, bound) for k, v in of_token.items()})


def told(context: np.ndarray, word: np.ndarray, share: np.ndarray, times: np.ndarray) -> np.ndarray:
    """log10 of each word's probability after its context over its share of the class, by the counts of all rows."""
    order = np.lexsort((word, context))
    c, w, n = context[order], word[order], times[order].astype(np.int64)
    fresh = np.concatenate(([True], c[1:] != c[:-1]))
    begin = np.flatnonzero(fresh | np.concatenate(([True], w[1:] != w[:-1])))
    each = np.add.reduceat(n, begin)
    group = np.cumsum(fresh) - 1
    total, distinct = np.bincount(group[begin], weights=each), np.bincount(group[begin], weights=each > 0)
    seen = np.repeat(each, np.diff(np.append(begin, len(c))))
    total, distinct = total[group], distinct[group]
    own = np.power(10.0, np.nan_to_num(share[order].astype(np.float64)))
    seen = np.where(np.isnan(share[order]), 0.0, seen / own)
    gain = np.empty(len(c))
    gain[order] = np.where(total > 0, np.log10(np.maximum(seen + distinct, 1) / np.maximum(total + distinct, 1)), 0.0)
    return gain


def _told(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """What the contexts of one bucket add to the score of each document, by the documents' bucket; notes pass."""
        asks = table.filter(table.column("asking").is_valid())
        rest = table.filter(table.column("asking").is_null())
        out = pa.table([rest.column("ask"), rest.column("docs"), rest.column("notes"), pa.nulls(rest.num_rows, pa.binary())], schema=_KEPT_ARROW)
        if not asks.num_rows:
            return out
        ids, sizes, share = (_joined(asks.column(c), kind) for c, kind in (("asking", np.int64), ("sizes", np.uint32), ("shares", np.float32)))
        times = np.repeat(_joined(asks.column("learnt"), np.uint8), sizes) * ~np.isnan(share)
        gain = told(_joined(asks.column("contexts"), np.uint32), _joined(asks.column("words"), np.uint32), share, times)
        docs, place = np.unique(ids, return_inverse=True)
        gain = np.bincount(np.repeat(place, sizes), weights=gain, minlength=len(docs))
        order, there, bound = _dealt(docs, n_buckets)
        return pa.concat_tables([out, pa.Table.from_batches([_rows(_KEPT_ARROW, dest=there, docs=_cut(docs[order], bound), gains=_cut(gain[order], bound))])])

    return run


def _total(table: pa.Table) -> pa.Table:
    """One row a document of a bucket: the sums of its notes and gains."""
    docs = [np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()]
    ids, place = np.unique(np.concatenate(docs), return_inverse=True)
    total = np.zeros((NOTES, len(ids)))
    upto = 0
    for d, notes, gains in zip(docs, table.column("notes").to_pylist(), table.column("gains").to_pylist(), strict=True):
        at, upto = place[upto : upto + len(d)], upto + len(d)
        if notes is None:
            np.add.at(total[3], at, np.frombuffer(gains))
        else:
            for k, x in enumerate(np.frombuffer(notes).reshape(-1, NOTES).T):
                np.add.at(total[k], at, x)
    return pa.table([pa.array(ids), *(pa.array(x.astype(np.int64) if k in (0, 1, 4) else x) for k, x in enumerate(total))], schema=_TOTAL_ARROW)


def _score(shared, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        model, keys_known, counts, complete = shared.value
        code = model.code
        mass = np.log10(code.mass)
        logs = np.log10(counts + 1.0)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for a, b, buf, off in chunks(batch.column("text"), SCORE_BYTES):
                keys, kind, first = tokens(buf, off)
                owner = np.repeat(np.arange(b - a), np.diff(first))
                uniq, inverse = np.unique(keys, return_inverse=True)
                at, known = _among(keys_known, uniq)
                worth = np.where(known, logs[at] if len(keys_known) else 0.0, 0.0)[inverse]
                known = known[inverse]
                sym = code.symbols(keys, kind)
                in_class = sym > code.end
                letters = np.where(known | ~in_class, 0.0, spelt(buf, off, model.spelling))
                of_class = mass[np.maximum(sym - code.end - 1, 0)]
                coded = model.log10(sym, first) + np.where(in_class, worth + letters - of_class, 0.0)
                per = lambda x: np.bincount(owner, weights=x, minlength=b - a)
                yield _noted(ids[a:b], np.stack((np.diff(first), per(known), per(worth), per(coded), np.diff(off))).astype(float), n_buckets)
                at = np.flatnonzero(in_class if complete else in_class & known)
                if len(at):
                    share = np.where(known[at], worth[at] - of_class[at], np.nan)
                    yield _asked(ids[a:b][owner[at]], train[a:b][owner[at]], _contexts(keys, kind, first, at), keys[at], share, n_buckets)

    return run


def _beyond(shared, n_buckets: int):
    """Tokens that the shared vocabulary lacks, by the bucket of their word, with their contexts and what spelling them costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        keys_known, spelling, mass = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for a, b, buf, off in chunks(batch.column("text"), SCORE_BYTES):
                keys, kind, first = tokens(buf, off)
                uniq, inverse = np.unique(keys, return_inverse=True)
                at = np.flatnonzero(~_among(keys_known, uniq)[1][inverse])
                if not len(at):
                    continue
                owner = np.repeat(np.arange(b - a), np.diff(first))[at]
                cells = {"docs": ids[a:b][owner].astype(np.int64), "keys": keys[at], "spelt": spelt(buf, off, spelling)[at], "contexts": _contexts(keys, kind, first, at), "masses": mass[kind[at]], "learnt": train[a:b][owner].astype(np.uint8)}
                order, there, bound = split_by_bucket(keys[at], n_buckets)
                yield _rows(_BEYOND_ARROW, bucket=there, **{k: _cut(v[order], bound) for k, v in cells.items()})

    return run


def _found(n_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Notes and asked contexts of the tokens beyond the shared vocabulary whose words lie in one bucket."""
        if not left.num_rows:
            return _SCORED_ARROW.empty_table()
        docs, learnt = _joined(left.column("docs"), np.int64), _joined(left.column("learnt"), np.uint8)
        order = np.argsort(docs, kind="stable")
        docs, learnt = docs[order], learnt[order]
        keys, context = (_joined(left.column(c), np.uint64)[order] for c in ("keys", "contexts"))
        letters, of_class = (_joined(left.column(c), np.float64)[order] for c in ("spelt", "masses"))
        vocab, counts = (_joined(right.column(c), kind) if right.num_rows else np.zeros(0, kind) for c, kind in (("vocab", np.uint64), ("counts", np.int64)))
        at, known = _among(vocab, keys)
        worth = np.where(known, np.log10(counts[at] + 1.0) if len(vocab) else 0.0, 0.0)
        word = keys != np.uint64(END_KEY)
        ids, place = np.unique(docs, return_inverse=True)
        per = lambda x: np.bincount(place, weights=x, minlength=len(ids))
        none = np.zeros(len(ids))
        out = [_noted(ids, np.stack((none, per(known), per(worth), per(np.where(known & word, worth - letters, 0.0)), none)), n_buckets)]
        if word.any():
            out.append(_asked(docs[word], learnt[word], context[word], keys[word], np.where(known, worth - of_class, np.nan)[word], n_buckets))
        return pa.Table.from_batches(out)

    return run


def lm_score(docs: DataFrame, train: Column, top: int = TOP) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document.

    ``train`` marks the rows that the model learns from.
    """
    spark = prepare(docs.sparkSession)
    work, n = Workspace(spark, "lm"), partitions(spark)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        least = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("text").cast("string")).alias("text"), F.max(train).alias("train"))
        rows = work.write(least.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("train", F.lit(False)).alias("train")), "once")
    learnt = rows.where("train").select("doc_id", "text")
    vocab = learnt.select("text").mapInArrow(_vocabulary(n), "bucket int, keys binary, kinds binary, counts binary")
    vocab = work.write(vocab.groupBy("bucket").applyInArrow(_merged(max(1, top // n)), _VOCAB), "vocab")
    shared = vocab.select("top_keys", "top_kinds", "top_counts", "n", "v", "weight").orderBy("bucket").collect()  # at most ``top`` words
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in shared]) if shared else np.zeros(0, kind)
    keys, kinds, counts = join("top_keys", np.uint64), join("top_kinds", np.uint8), join("top_counts", np.int64)
    order = np.argsort(keys)
    keys, kinds, counts = keys[order], kinds[order], counts[order]
    total, distinct = sum(r["n"] for r in shared), sum(r["v"] for r in shared)
    weight = sum((np.frombuffer(r["weight"], np.int64) for r in shared), np.zeros(CLASSES, np.int64))
    code = Code(keys, kinds, counts, weight)
    shards = min(MAX_SHARDS, max(1, -(-learnt.count() // SHARD_DOCS)))
    dealt = learnt.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    parts = min(shards, 4 * n)
    dealt = dealt.repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard", "doc_id").select("shard", "text")
    state = work.write(dealt.mapInArrow(_train(code), _STATE), "state")
    while shards > 1:
        state = state.groupBy("part", F.floor(F.col("shard") / FAN).alias("set")).applyInArrow(_add, _STATE)
        shards = -(-shards // FAN)
    model = Model(code, state.collect())  # a fixed number of slots
    work.drop("state")
    known = spark.sparkContext.broadcast((model, keys, counts, len(keys) == distinct))
    texts = rows.select("doc_id", "text", "train")
    scored = texts.mapInArrow(_score(known, n), _SCORED)
    if len(keys) < distinct:
        spelling = spark.sparkContext.broadcast((keys, model.spelling, np.log10(code.mass)))
        beyond = texts.mapInArrow(_beyond(spelling, n), _BEYOND).groupBy("bucket")
        scored = scored.unionByName(beyond.cogroup(vocab.select("bucket", F.col("keys").alias("vocab"), "counts").groupBy("bucket")).applyInArrow(_found(n), _SCORED))
    told_of = scored.groupBy("ask").applyInArrow(_told(n), _KEPT)
    out = work.write(told_of.groupBy("dest").applyInArrow(_total, _TOTAL), "scored")
    base = F.col("counted") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    bits = -F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
