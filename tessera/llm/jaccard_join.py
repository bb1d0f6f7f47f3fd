"""N-gram Jaccard self-join with PartEnum signatures.

The feature domain (64-bit shingle hashes) is partitioned by hash into cells, and the subsets enumerated are single
cells: a signature is the hash of a document's features within one. Documents are banded by size: a document joins
each band that can hold the smaller side of a pair it is part of, so the two sides of a similar pair always meet in
the smaller side's band. There their symmetric difference is at most ``k = floor(size/3)`` (Jaccard >= 3/4), and a band
has ``k + 1 + slack`` cells. ``k`` differences leave ``slack + 1`` cells as they are; a document with at most ``slack``
empty cells therefore shares the signature of a filled one with every partner. One with more empty cells also joins the
next family of cells, under another hash, and one that has too many in all ``FAMILIES`` lets every feature be a
signature. Both sides of a pair are in the first family in which either has few empty cells, so no link is lost.

Every link is verified by exact set intersection. Rows stay linear in the signatures:

* equal sets are one representative (a copy costs one row);
* a signature group is first linked as a star to its smallest member; components of the verified star edges then show
  which groups still span several components, and only those are looked at again, across components;
* a larger group than ``TILE`` (a passage that many documents share) is split by its members' rarest shingles: two linked
  documents share one of the first ``n - ceil(3n/4) + 1`` shingles of each in any common order, here with the
  shingles of more than ``TILE`` such documents last, so the passage itself is reached only in documents that are hardly
  more than it. What is still over ``TILE`` members is compared tile by tile, in as many tasks;
* in a group, members whose sizes and parity sketches allow a link across components are told first, as clusters that such
  possible links connect. Each document is in one cluster and its set is sent there once; every cluster yields a forest of
  verified links, fewer than its members.

A parity sketch has a bit for each of ``2^b`` bins, set where a bin holds an odd number of features: two sketches differ in
no more bits than the sets in features, so that what it rules out is no link.

Null, empty and blank texts have the empty set and link with nothing. Repeated rows of one doc_id
count as one document with the least non-null text; rows without doc_id are no documents.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Workspace, components, partitions, prepare, tidy
from tessera.llm.textops import chunks, mix, shingle_sets, split_by_bucket

BAND_RATIO = 4 / 3
FAMILIES = 8
#: Bytes of text whose shingles are made at once.
CHUNK = 1 << 19
#: Members that are compared by their sketches in one task.
TILE = 2048
#: Members of one row of a group.
PART = 4096
#: Words of sketches compared at a time.
PAIR_WORDS = 1 << 19
#: Least bits of a parity sketch; larger sets have two bits a feature or more.
SKETCH_BITS = 1024
#: Frequent shingles known to every worker (16 MB); those beyond count as rare, which changes the order alone.
HOT_SHINGLES = 1_000_000
#: Document ids that may be broadcast when texts of candidates are read again (16 MB of longs).
BROADCAST_IDS = 2_000_000

_C = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def slack(low: int, k: int) -> int:
    """Empty cells allowed for: what a set of ``low`` features has, and two and a half deviations more."""
    s = 0
    while True:
        n = k + 1 + s
        load = low / n
        empty = math.exp(-load)
        if n * empty + 2.5 * math.sqrt(n * empty * (1 - (1 + load) * empty)) <= s:
            return s
        s += 1


def bands(largest: int) -> list[tuple[int, int, int, int]]:
    """(low, high, cells, slack) of every size band up to ``largest``; sizes under 3 match only equal sets."""
    out, low = [], 3
    while low <= largest:
        high = max(low + 1, int(low * BAND_RATIO))
        k = (high - 1) // 3
        spare = slack(low, k)
        out.append((low, high, k + 1 + spare, spare))
        low = high
    return out


_bands: list[tuple[int, int, int, int]] = []


def bands_of(size: int) -> list[tuple[int, int, int, int, int]]:
    """Bands in which a document of this size may meet a partner, with their numbers."""
    global _bands
    if not _bands or _bands[-1][1] <= size:
        _bands = bands(max(2 * size, 4096))
    least = -(-3 * size // 4)
    return [(i, *b) for i, b in enumerate(_bands) if b[0] <= size and b[1] > least]


def _seed(*numbers: int) -> np.uint64:
    out = 0
    for x in numbers:
        out = (out * 0x100000001B3 + x + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)
    return np.uint64(out)


def signatures(features: np.ndarray) -> np.ndarray:
    """PartEnum signatures of one feature set (sorted distinct uint64 hashes)."""
    out = []
    for number, _, _, cells, spare in bands_of(len(features)):
        for family in range(FAMILIES):
            seeded = mix(features ^ _seed(number, family))
            cell = ((seeded >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            sums = np.add.reduceat(mix(seeded[order] * _C[0]), first)
            out.append(mix(sums + cell[first] * _C[1] + _seed(number, family)))
            if cells - len(first) <= spare:
                break
        else:
            out.append(mix(features + _seed(number, FAMILIES)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(features: np.ndarray) -> bytes:
    """Parity of the number of features in each of 2^b bins, two bins a feature at least."""
    bits = max(SKETCH_BITS, 1 << (2 * len(features) - 1).bit_length()) if len(features) else SKETCH_BITS
    odd = np.bincount((features & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches (rows of words) with half the bins each."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def differing(one: bytes, other: bytes) -> int:
    """Least number of features in which the sets of two sketches differ."""
    x, y = (np.frombuffer(v, np.uint64)[None] for v in (one, other))
    while x.shape[1] != y.shape[1]:
        x, y = (folded(v) if v.shape[1] > min(x.shape[1], y.shape[1]) else v for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in chunks(batch.column("text"), CHUNK):
            n, h1, h2, sk = [], [], [], []
            for s in shingle_sets(buf, off):
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                sk.append(sketch(s))
                h2.append(int(mix(s * _C[1]).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sketch"])


def _emit(keys_of: Callable[[np.ndarray], np.ndarray], n_buckets: int):
    """Documents by ``keys_of`` their sets, packed by bucket of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sigs, held = [], [], 0

        def flush():
            keys = np.concatenate(sigs)
            owner = np.repeat(np.array(ids, dtype=np.int64), [len(s) for s in sigs])
            order, there, bound = split_by_bucket(keys, n_buckets)
            low, owner = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], owner[order]
            rows = []
            for k in range(len(there)):
                x, y = bound[k], bound[k + 1]
                docs, local = np.unique(owner[x:y], return_inverse=True)
                rows.append((docs.tobytes(), local.astype(np.uint32 if len(docs) > 65535 else np.uint16).tobytes(), low[x:y].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))], ["bucket", "docs", "owner", "sig"])

        for batch in batches:
            doc = batch.column("doc_id").to_pylist()
            for a, b, buf, off in chunks(batch.column("text"), CHUNK):
                for d, s in zip(doc[a:b], shingle_sets(buf, off), strict=True):
                    g = keys_of(s)
                    if len(g):
                        ids.append(d)
                        sigs.append(g)
                        held += len(g)
                    if held > 3_000_000:
                        yield flush()
                        ids, sigs, held = [], [], 0
        if ids:
            yield flush()

    return run


def _meet(stars: bool):
    return lambda table: _met(table, stars)


def _met(table: pa.Table, stars: bool) -> pa.Table:
    """Documents that share keys of one bucket: groups (gid, n, members), told apart by their members, and
    where wanted (null, leader, members) for all that meet with a smallest member; a group of two is no more than that."""
    sig = [np.frombuffer(x, np.uint32) for x in table.column("sig").to_pylist()]
    doc = []
    for d, o, s in zip(table.column("docs").to_pylist(), table.column("owner").to_pylist(), sig, strict=True):
        d = np.frombuffer(d, np.int64)
        doc.append(d[np.frombuffer(o, np.uint32 if len(o) == 4 * len(s) else np.uint16)])
    sig, doc = np.concatenate(sig), np.concatenate(doc)
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
    sig, doc = sig[keep], doc[keep]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(first, len(sig)))
    rank = np.arange(len(sig)) - np.repeat(first, size)
    key = np.add.reduceat(mix(mix(doc.astype(np.uint64)) + rank.astype(np.uint64) * _C[0]), first).astype(np.int64)
    first, size, key = first[size > 1], size[size > 1], key[size > 1]
    _, fresh = np.unique(key, return_index=True)
    first, size, key = first[fresh], size[fresh], key[fresh]
    out = [_parts(key, np.zeros(0, np.int64), size, first, doc)] if not stars else []
    if stars:
        wide = size > 2
        out.append(_parts(key[wide], np.zeros(0, np.int64), size[wide], first[wide], doc))
        flat = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        met = np.unique(np.stack((np.repeat(doc[first], size), doc[flat])), axis=1)
        met = met[:, met[0] != met[1]]
        begin = np.flatnonzero(np.concatenate(([True], met[0][1:] != met[0][:-1]))) if met.shape[1] else np.zeros(0, np.int64)
        out.append(_parts(np.zeros(0, np.int64), met[0][begin], np.diff(np.append(begin, met.shape[1])), begin, met[1]))
    return pa.concat_tables(out)


def _parts(gid: np.ndarray, leader: np.ndarray, size: np.ndarray, first: np.ndarray, doc: np.ndarray) -> pa.Table:
    """Runs of ``doc`` as rows of at most PART members, with the run's gid and size, or its leader."""
    parts = -(-size // PART)
    which = np.repeat(np.arange(len(size)), parts)
    skip = PART * (np.arange(len(which)) - np.repeat(np.concatenate(([0], np.cumsum(parts)[:-1])), parts)) if len(size) else which
    n = np.minimum(size[which] - skip, PART)
    off = np.concatenate(([0], np.cumsum(n)))
    flat = np.repeat(first[which] + skip - off[:-1], n) + np.arange(off[-1])
    some = lambda x: pa.array(x[which]) if len(x) else pa.nulls(len(which), pa.int64())
    return pa.table([some(gid), some(leader), pa.array(size[which]), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(doc[flat]))], names=["gid", "leader", "n", "members"])


def _groups(docs: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], work: Workspace, name: str, stars: bool = False) -> DataFrame:
    n = partitions(docs.sparkSession)
    met = docs.mapInArrow(tidy(_emit(keys_of, n)), "bucket int, docs binary, owner binary, sig binary")
    return work.write(met.repartition(n, "bucket").groupBy("bucket").applyInArrow(_meet(stars), "gid long, leader long, n long, members array<long>"), name)


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in chunks(batch.column("text"), CHUNK):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(buf, off)], pa.binary())], ["doc_id", "feats"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 3/4 or more."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int((y[at] == x).sum())
    return 100 * same >= 75 * (len(x) + len(y) - same)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(*(np.frombuffer(v.as_buffer(), np.uint64) for v in p)) for p in zip(batch.column("fa"), batch.column("fb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        keep = np.minimum(na, nb) * 4 >= np.maximum(na, nb) * 3
        for i in np.flatnonzero(keep).tolist():
            keep[i] = 7 * differing(batch.column("sa")[i].as_buffer(), batch.column("sb")[i].as_buffer()) <= na[i] + nb[i]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _links(pairs: DataFrame, reps: DataFrame, sizes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) whose shingle sets have Jaccard similarity of 3/4 or more."""
    side = lambda c: sizes.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    pairs = work.write(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible, "a long, b long"), f"{name}-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = work.write(reps.join(_few(ids), "doc_id", "left_semi").mapInArrow(tidy(_emit_sets), "doc_id long, feats binary"), f"{name}-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("feats").alias("fa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("feats").alias("fb"))
    found = work.write(pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(_verify, "a long, b long"), f"{name}-links")
    work.drop(f"{name}-pairs", f"{name}-sets")
    return found


def _spanning(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """(gid, n, doc, component) of the groups whose members are in several components."""
    wide = groups.where("gid is not null").dropDuplicates(["gid", "members"]).select("gid", "n", F.explode("members").alias("doc"))
    wide = wide.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = wide.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gid")
    return wide.join(mixed, "gid", "left_semi")


def _frequent(n_buckets: int):
    def count(table: pa.Table) -> pa.Table:
        feats, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("feats").to_pylist()]), return_counts=True)
        hot = n > TILE
        return pa.table([pa.array(feats[hot].view(np.int64)), pa.array(n[hot], pa.int64())], names=["feat", "df"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in chunks(batch.column("text")):
                feats = np.concatenate(shingle_sets(buf, off))
                order, there, bound = split_by_bucket(feats, n_buckets)
                feats = feats[order]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([feats[x:y].tobytes() for x, y in zip(bound[:-1], bound[1:], strict=True)], pa.binary())], ["bucket", "feats"])

    return pack, count


def _by_rarest(suspects: DataFrame, reps: DataFrame, work: Workspace) -> DataFrame:
    """Groups of ``suspects`` (doc) by each of their rarest shingles."""
    n = partitions(reps.sparkSession)
    texts = work.write(reps.join(_few(suspects.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi"), "suspect-texts")
    pack, count = _frequent(n)
    hot = texts.mapInArrow(pack, "bucket int, feats binary").groupBy("bucket").applyInArrow(count, "feat long, df long")
    hot = hot.orderBy(F.desc("df"), "feat").limit(HOT_SHINGLES).collect()
    by_feat = sorted((np.uint64(r["feat"] & 2**64 - 1), -i) for i, r in enumerate(hot))
    known, place = np.array([f for f, _ in by_feat], np.uint64), np.array([p for _, p in by_feat], np.int64)

    def rarest(features: np.ndarray) -> np.ndarray:
        rank = np.full(len(features), -len(known) - 1, np.int64)
        if len(known):
            at = np.searchsorted(known, features)
            at[at == len(known)] = 0
            rank = np.where(known[at] == features, place[at], rank)
        return features[np.lexsort((features, rank))][: len(features) - -(-3 * len(features) // 4) + 1]

    return _groups(texts, rarest, work, "rare")


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    at = np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys)).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def candidates(size: np.ndarray, component: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's members (in order of size), from different components, that sizes and sketches allow to link."""
    words = np.array([len(s) // 8 for s in sketches])
    one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = {w: (np.flatnonzero(words == w), np.frombuffer(b"".join(s for s in sketches if len(s) == 8 * w), np.uint64).reshape(-1, w)) for w in np.unique(words).tolist()}
    for w, (left, mine) in rows.items():
        for v, (right, theirs) in rows.items():
            if v < w:  # a smaller sketch is one of a smaller set
                continue
            while theirs.shape[1] > w:
                theirs = folded(theirs)
            step = max(1, PAIR_WORDS // (w * len(right)))
            for x in range(0, len(left), step):
                i, j = left[x : x + step, None], right[None]
                may = (i < j) & (3 * size[j] <= 4 * size[i]) & (component[i] != component[j])
                if may.any():
                    away = np.bitwise_count(mine[x : x + step, None] ^ theirs[None]).sum(2, dtype=np.int64)
                    p, q = np.nonzero(may & (7 * away <= size[i] + size[j]))
                    one.append(left[x + p])
                    other.append(right[q])
    return np.concatenate(one), np.concatenate(other)


def _hopeful(table: pa.Table) -> pa.Table:
    """(a, b): members of groups that may link with one of a different component, with the least one that this connects them to."""
    gid, doc, comp, size = (table.column(c).to_numpy() for c in ("gid", "doc", "component", "n_shingles"))
    order = np.lexsort((doc, size, gid))
    sketches = table.column("sketch").to_pylist()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in _bounds(gid[order]):
        at = order[x:y]
        if (comp[at] == comp[at[0]]).all():
            continue
        one, other = candidates(size[at], comp[at], [sketches[k] for k in at])
        if len(one):
            label = doc[at]
            while True:
                low = label.copy()
                np.minimum.at(low, one, label[other])
                np.minimum.at(low, other, low[one])
                if (low == label).all():
                    break
                label = low
            tied = label != doc[at]
            a.append(doc[at][tied])
            b.append(label[tied])
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
    return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _forest(table: pa.Table) -> pa.Table:
    """Verified links (a, b) that join the components of each group's members: a forest over those met in one task."""
    gid, doc, comp = (table.column(c).to_numpy() for c in ("gid", "doc", "component"))
    feats = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("feats")]
    size, sketches = np.array([len(f) for f in feats], np.int64), [sketch(f) for f in feats]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    a, b, order = [], [], np.lexsort((doc, size, gid))
    for x, y in _bounds(gid[order]):
        at = order[x:y]
        now = np.array([find(c) for c in comp[at].tolist()])
        for i, j in zip(*candidates(size[at], now, [sketches[k] for k in at]), strict=True):
            one, other = at[i], at[j]
            if find(int(comp[one])) != find(int(comp[other])) and linked(feats[one], feats[other]):
                root[find(int(comp[other]))] = find(int(comp[one]))
                a.append(min(doc[one], doc[other]))
                b.append(max(doc[one], doc[other]))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _tiled(groups: DataFrame) -> DataFrame:
    """Groups (gid, n, doc, component) with those over TILE members dealt to blocks: each member goes to every pair of blocks that its own is in."""
    own, other = F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int"), F.col("other")
    dealt = groups.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select(F.xxhash64("gid", F.least(own, other), F.greatest(own, other)).alias("gid"), "doc", "component")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies, kept, n_rows for every document of ``docs`` (doc_id long, text string).

    component_id is the smallest doc_id reachable over links of Jaccard similarity of 0.75 or more on
    5-word shingles. n_copies counts the documents with the same set; kept marks the one of each component; n_rows counts the rows
    of the doc_id.
    """
    spark = prepare(docs.sparkSession)
    work, n = Workspace(spark, "jaccard"), partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def size_up(docs: DataFrame, name: str) -> DataFrame:
        found = docs.mapInArrow(tidy(_sizes), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary")
        return work.write(found.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "h1", "h2", "sketch")).alias("s"), F.count("*").alias("n_rows")).select("doc_id", "s.*", "n_rows"), name)

    sized = size_up(docs, "sizes")
    if not sized.where("n_rows > 1").isEmpty():
        repeats = sized.select("doc_id", "n_rows")
        docs = work.write(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "once")
        sized = size_up(docs, "sizes-once")
        sized = sized.drop("n_rows").join(repeats, "doc_id")
    classes = work.write(sized.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "classes")
    copies = sized.where("n_shingles > 0").join(classes.where("n_copies > 1"), ["n_shingles", "h1", "h2"]).where("doc_id <> rep")
    # later copies leave before signatures are made; their number decides how
    reps = docs.join(_few(copies.select("doc_id")), "doc_id", "left_anti")
    groups = _groups(reps, signatures, work, "groups", stars=True)
    stars = groups.where("gid is null").select(F.col("leader").alias("a"), F.explode("members").alias("b")).distinct()
    links = _links(stars, reps, sized, work, "star")
    comp = work.write(components(links, work, "cc"), "comp")
    spanning = work.write(_spanning(groups, comp), "spanning")
    suspects = work.write(spanning.where(F.col("n") > TILE).select("doc").distinct(), "suspects")
    rest = spanning.where(F.col("n") <= TILE).select("gid", "doc", "component")
    if not suspects.isEmpty():
        rest = rest.unionByName(_tiled(_spanning(_by_rarest(suspects, reps, work), comp)))
    bucket = F.pmod(F.xxhash64("gid"), F.lit(4 * n)).cast("int").alias("bucket")
    known = sized.select(F.col("doc_id").alias("doc"), "n_shingles", "sketch")
    hopeful = rest.join(known, "doc").select(bucket, "gid", "doc", "component", "n_shingles", "sketch").groupBy("bucket").applyInArrow(_hopeful, "a long, b long")
    hopeful = work.write(hopeful.distinct(), "hopeful")
    if not hopeful.isEmpty():
        cluster = work.write(components(hopeful, work, "clusters"), "clustered").select(F.col("node").alias("doc"), F.col("component").alias("gid"))
        sets = reps.join(_few(cluster.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(tidy(_emit_sets), "doc_id long, feats binary")
        placed = cluster.join(cluster.groupBy("gid").agg(F.count("*").alias("n")), "gid").join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        more = _tiled(placed).join(sets.withColumnRenamed("doc_id", "doc"), "doc").select(bucket, "gid", "doc", "component", "feats").groupBy("bucket").applyInArrow(_forest, "a long, b long")
        more = work.write(more.distinct(), "more")
        if not more.isEmpty():
            comp = work.write(components(links.unionByName(more), work, "cc2"), "final")
    work.drop("groups", "spanning", "suspects", "suspect-texts", "rare", "hopeful", "clustered", "star-links", "more")
    # the smallest doc_id of a component: the smallest over its classes' representatives
    found = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    found = sized.drop("sketch").join(found, ["n_shingles", "h1", "h2"], "left")
    own = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), (own == F.col("doc_id")).alias("kept"), F.col("n_rows").cast("long").alias("n_rows"))
