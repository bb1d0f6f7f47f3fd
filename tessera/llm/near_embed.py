"""Near-duplicate embeddings by NN-descent.

The neighbour graph starts from sorted orders: vectors lie in the order of a random-hyperplane code, and
overlapping windows find each vector's nearest within the window. There are so many orders that a pair at the
threshold misses every window with a probability of ``1 - RECALL`` at most, so their number grows with the table.
Rounds of neighbours-of-neighbours joins then refine the graph until no more listed pairs link: at each vector meet
its neighbours and those that list it (in parts of ``K``, so none is left out), and all of that small set are compared
with each other. Every compared pair of cosine >= ``THRESHOLD`` joins components at once. A vector whose list is
saturated (its worst member is still above the threshold) may have further links that no list shows: it is
compared with every other vector in tiles. Links are then counted within components, without listing them.

A recall audit holds ``AUDIT`` vectors of large components and ``AUDIT`` of the others against all vectors, equal
vectors counting once. While the mean recall of either group is under ``RECALL``, orders are added and windows
doubled; after ``ATTEMPTS`` of that all vectors are compared with each other.

Equal vectors are one representative with a count. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and vectors of different length do not link. Repeated vec_ids are one vector, the
least in byte order. Cosines are in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Workspace, components, partitions, prepare

THRESHOLD = 0.9
K = 10
ORDERS = 6
ROUNDS = 2
WINDOW = 128
#: Half windows that one task compares at a time.
SPAN = 32
ATTEMPTS = 3
AUDIT = 200
RECALL = 0.98
TILE = 2048


def _orders(n: int) -> int:
    """Orders in which a pair at the threshold shares a window at least once with probability RECALL, among n vectors."""
    meet = (1 - np.arccos(THRESHOLD) / np.pi) ** max(1.0, np.log2(max(n, 2) / (WINDOW / 2)))
    return max(ORDERS, int(np.ceil(np.log(1 - RECALL) / np.log(1 - meet))))


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f4") for r in rows]).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for v in batch.column("embedding"):
            v = v.as_py()
            x = None if not v or any(c is None for c in v) else np.array(v, dtype="<f4")
            out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])


def _codes(first: int, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column("v").to_pylist()
            size = np.array([len(r) for r in rows])
            for n in np.unique(size):
                if n not in planes:
                    planes[n] = np.random.default_rng([7, int(n)]).standard_normal((64 * last, n // 4))
                at = np.flatnonzero(size == n)
                x = _unit([rows[i] for i in at])
                for t in range(first, last):
                    bits = x @ planes[n][64 * t : 64 * t + 40].T > 0
                    code = bits @ (np.int64(1) << np.arange(39, -1, -1)) + (np.int64(n) << 44)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int32()), pa.array(code, pa.int64()), batch.column("rep").take(pa.array(at)), batch.column("v").take(pa.array(at))], ["t", "code", "rep", "v"])

    return run


def _nearest(ids: np.ndarray, rows: list[bytes], k: int) -> tuple[list, list, list, list, list]:
    """Among a small set: each vector's k nearest with cosines, and the set's components above the threshold."""
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    size = np.array([len(r) for r in rows])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if len(at) < 2:
            continue
        x = _unit([rows[i] for i in at])
        own = ids[at]
        sim = x @ x.T
        sim[own[:, None] == own[None, :]] = -2
        near = np.argpartition(-sim, min(k, len(at) - 1) - 1, axis=1)[:, : min(k, len(at) - 1)]
        out[0].extend(own.tolist())
        out[1].extend(own[near].tolist())
        out[2].extend(np.take_along_axis(sim, near, 1).tolist())
        link = sim >= THRESHOLD
        label = own.copy()
        if link.any():
            i, j = np.nonzero(link)
            while True:
                low = label.copy()
                np.minimum.at(low, i, label[j])
                if (low == label).all():
                    break
                label = low
            tied = label != own
            out[3].extend(own[tied].tolist())
            out[4].extend(label[tied].tolist())
    return out


_FOUND = "rep long, nbr array<long>, sim array<double>, a long, b long"


def _found(part: tuple[list, list, list, list, list]) -> pa.RecordBatch:
    ids, nbr, sim, a, b = part
    n, m = len(ids), len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids + [None] * m, pa.int64()), pa.array(nbr + [None] * m, pa.list_(pa.int64())), pa.array(sim + [None] * m, pa.list_(pa.float64())), pa.array([None] * n + a, pa.int64()), pa.array([None] * n + b, pa.int64())],
        ["rep", "nbr", "sim", "a", "b"],
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        m = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array(np.arange(n, n + m)), batch.column("rep"), batch.column("v")], ["part", "at", "rep", "v"])
        n += m


def _windows(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        ids, rows = table.column("rep").to_numpy(), table.column("v").to_pylist()
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for x in range(0, max(1, len(ids) - window // 2), window // 2):
            if len(ids[x : x + window]) > 1:
                for have, new in zip(out, _nearest(ids[x : x + window], rows[x : x + window], K), strict=True):
                    have.extend(new)
        return pa.Table.from_batches([_found(out)])

    return run


def _in_windows(codes: DataFrame, work: Workspace, n: int, attempt: int, window: int) -> DataFrame:
    """Windows over one order of all rows: they reach across the edges of partitions."""
    order = codes.repartitionByRange(n, "t", "code", "rep").sortWithinPartitions("t", "code", "rep")
    order = work.write(order.mapInArrow(_numbered, "part int, at long, rep long, v binary"), f"order-{attempt}")
    begin, ends = 0, []
    for part, m in sorted(tuple(r) for r in order.groupBy("part").agg(F.count("*")).collect()):  # one row a partition
        ends.append((part, begin))
        begin += m
    ends = order.sparkSession.createDataFrame(ends, "part int, begin long")
    at = order.join(F.broadcast(ends), "part").select((F.col("begin") + F.col("at")).alias("at"), "rep", "v")
    half = F.floor(F.col("at") / (window // 2))
    own = F.floor(half / SPAN)
    spans = F.when((half % SPAN == 0) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return at.withColumn("span", F.explode(spans)).groupBy("span").applyInArrow(_windows(window), _FOUND)


def _merge(table: pa.Table) -> pa.Table:
    """The best K of all lists of each vector in one bucket."""
    lists, values = (table.column(c).combine_chunks() for c in ("nbr", "sim"))
    rep = np.repeat(table.column("rep").to_numpy(), pc.list_value_length(lists).to_numpy())
    nbr, sim = lists.flatten().to_numpy(), values.flatten().to_numpy()
    order = np.lexsort((-sim, nbr, rep))
    rep, nbr, sim = rep[order], nbr[order], sim[order]
    keep = np.concatenate(([True], (rep[1:] != rep[:-1]) | (nbr[1:] != nbr[:-1])))
    rep, nbr, sim = rep[keep], nbr[keep], sim[keep]
    order = np.lexsort((nbr, -sim, rep))
    rep, nbr, sim = rep[order], nbr[order], sim[order]
    begin = np.flatnonzero(np.concatenate(([True], rep[1:] != rep[:-1])))
    rank = np.arange(len(rep)) - np.repeat(begin, np.diff(np.append(begin, len(rep))))
    keep = rank < K
    return pa.table([pa.array(rep[keep]), pa.array(nbr[keep]), pa.array(sim[keep])], names=["rep", "nbr", "sim"])


def _graph(found: DataFrame, n: int) -> DataFrame:
    lists = found.where("rep is not null").select(F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int").alias("bucket"), "rep", "nbr", "sim")
    return lists.groupBy("bucket").applyInArrow(_merge, "rep long, nbr long, sim double")


def _local(table: pa.Table) -> pa.Table:
    """Neighbours of neighbours: all that meet at one pivot, or at one part of it, are compared with each other."""
    pivot, part, ids, rows = (*(table.column(c).to_numpy() for c in ("pivot", "part", "rep")), table.column("v").to_pylist())
    order = np.lexsort((ids, part, pivot))
    p, q = pivot[order], part[order]
    begin = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    for x, y in zip(begin, np.append(begin[1:], len(order)), strict=True):
        at = order[x:y]
        at = at[np.concatenate(([True], ids[at][1:] != ids[at][:-1]))]
        if len(at) > 1:
            for have, new in zip(out, _nearest(ids[at], [rows[i] for i in at], K), strict=True):
                have.extend(new)
    return pa.Table.from_batches([_found(out)])


def _across(table: pa.Table) -> pa.Table:
    """Links between the left and the right rows of one tile, as each row's smallest linked vector."""
    side, rep, rows = table.column("side").to_numpy(), table.column("rep").to_numpy(), table.column("v").to_pylist()
    size = np.array([len(r) for r in rows])
    a, b = [], []
    for n in np.unique(size):
        left, right = np.flatnonzero((side == 0) & (size == n)), np.flatnonzero((side == 1) & (size == n))
        if not len(left) or not len(right):
            continue
        link = _unit([rows[i] for i in left]) @ _unit([rows[i] for i in right]).T >= THRESHOLD
        x, y, none = rep[left], rep[right], np.iinfo(np.int64).max
        while True:
            low = np.minimum(x, np.where(link, y[None, :], none).min(1))
            far = np.minimum(y, np.where(link, low[:, None], none).min(0))
            if (low == x).all() and (far == y).all():
                break
            x, y = low, far
        for own, label in ((rep[left], x), (rep[right], y)):
            a.extend(own[label != own].tolist())
            b.extend(label[label != own].tolist())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _exact(some: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b) that connect each vector of ``some`` with all that it links with among ``reps``, compared pair by pair in tiles."""
    rows, cols = (max(1, -(-d.count() // TILE)) for d in (some, reps))
    tile = lambda g: F.pmod(F.xxhash64("rep"), F.lit(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    left = some.select("rep", "v", F.lit(0).alias("side"), tile(rows).alias("i"), every(cols).alias("j"))
    right = reps.select("rep", "v", F.lit(1).alias("side"), tile(cols).alias("j"), every(rows).alias("i")).select("rep", "v", "side", "i", "j")
    return left.unionByName(right).groupBy("i", "j").applyInArrow(_across, "a long, b long")


def _tiles(table: pa.Table) -> pa.Table:
    """For the left rows of one tile: copies and distinct vectors linked among the right rows (themselves left out)."""
    side = table.column("side").to_numpy()
    rep, w, rows = table.column("rep").to_numpy(), table.column("n_copies").to_numpy(), table.column("v").to_pylist()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    total, linked = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    if len(left) and len(right):
        x, y = _unit([rows[i] for i in left]), _unit([rows[i] for i in right])
        link = (x @ y.T >= THRESHOLD) & (rep[left][:, None] != rep[right][None, :])
        total, linked = link @ w[right], link.sum(1)
    return pa.table([pa.array(rep[left], pa.int64()), pa.array(total, pa.int64()), pa.array(linked, pa.int64())], names=["rep", "others", "linked"])


def near_embeddings(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept, n_copies) of every vec_id of ``vectors`` (vec_id long, embedding array<float>)."""
    spark = prepare(vectors.sparkSession)
    work, n = Workspace(spark, "embed"), partitions(spark)
    packed = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(_pack, "vec_id long, v binary")
    packed = work.write(packed.groupBy("vec_id").agg(F.min("v").alias("v")), "packed")
    reps = work.write(packed.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n_copies")), "reps")
    size = reps.count()
    orders, links, done = _orders(size), [], None
    lists: list[DataFrame] = []
    for attempt in range(ATTEMPTS + 1):
        if attempt == ATTEMPTS:
            links = [work.write(_exact(reps, reps), "exact")]
        else:
            codes = reps.mapInArrow(_codes(attempt * orders, (attempt + 1) * orders), "t int, code long, rep long, v binary")
            found = work.write(_in_windows(codes, work, n, attempt, WINDOW << attempt), f"init-{attempt}")
            lists.append(found.select("rep", "nbr", "sim"))
            links.append(found.select("a", "b"))
            graph = work.write(_graph(_all(lists), n), f"graph-{attempt}-0")
            r, before, linked = 0, -1, _linked(graph)
            while r < ROUNDS or linked > before:
                r, before = r + 1, linked
                new = work.write(_round(graph, reps, n), f"round-{attempt}-{r}")
                old = graph.groupBy("rep").agg(F.collect_list("nbr").alias("nbr"), F.collect_list("sim").alias("sim")).select("rep", "nbr", "sim")
                graph = work.write(_graph(old.unionByName(new.select("rep", "nbr", "sim")), n), f"graph-{attempt}-{r}")
                links.append(new.select("a", "b"))
                linked = _linked(graph)
            lists.append(graph.groupBy("rep").agg(F.collect_list("nbr").alias("nbr"), F.collect_list("sim").alias("sim")).select("rep", "nbr", "sim"))
            full = graph.groupBy("rep").agg(F.count("*").alias("m"), F.min("sim").alias("worst")).where((F.col("m") >= K) & (F.col("worst") >= THRESHOLD)).select("rep")
            full = work.write((full if done is None else full.join(done, "rep", "left_anti")).join(reps, "rep").select("rep", "v"), f"full-{attempt}")
            if not full.isEmpty():
                links.append(work.write(_exact(full, reps), f"exact-{attempt}"))
                done = full.select("rep") if done is None else done.unionByName(full.select("rep"))
        comp = work.write(components(_all(links).where("a is not null").distinct(), work, f"cc-{attempt}"), f"comp-{attempt}")
        members = reps.join(comp.withColumnRenamed("node", "rep"), "rep")
        result = work.write(_counted(members, work, attempt), f"counted-{attempt}")
        if attempt == ATTEMPTS or audit(reps, result) >= RECALL:
            break
    out = packed.join(reps.join(result, "rep", "left"), "v", "left")
    out = out.select("vec_id", F.coalesce(F.col("others") + F.col("n_copies") - 1, F.col("n_copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
    # the smallest vec_id of a component is that of its representatives, each the smallest of its copies
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).select("vec_id", "n_links", "component_id", "kept", "n_copies")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _linked(graph: DataFrame) -> int:
    return graph.where(F.col("sim") >= THRESHOLD).count()


def _round(graph: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """At each pivot meet itself, its list and those that list it, K of the latter in each part of the pivot."""
    best = Window.partitionBy("nbr").orderBy(F.desc("sim"), "rep")
    back = graph.select(F.col("nbr").alias("pivot"), F.floor((F.row_number().over(best) - 1) / K).cast("int").alias("part"), "rep")
    parts = back.groupBy("pivot").agg(F.max("part").alias("last"))
    own = graph.select(F.col("rep").alias("pivot"), F.col("nbr").alias("rep")).unionByName(reps.select(F.col("rep").alias("pivot"), "rep"))
    own = own.join(parts, "pivot", "left").select("pivot", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("part"), "rep")
    meet = own.unionByName(back).distinct().join(reps.select("rep", "v"), "rep")
    meet = meet.select(F.pmod(F.xxhash64("pivot", "part"), F.lit(4 * n)).cast("int").alias("bucket"), "pivot", "part", "rep", "v")
    return meet.groupBy("bucket").applyInArrow(_local, _FOUND)


def _counted(members: DataFrame, work: Workspace, attempt: int) -> DataFrame:
    """(rep, component, others, linked): copies of other texts, and texts, linked with each member, counted in tiles of its component."""
    size = members.groupBy("component").agg(F.count("*").alias("m"))
    tiled = members.join(size, "component").withColumn("g", F.ceil(F.col("m") / TILE).cast("int")).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    cols = ["component", "rep", "n_copies", "v"]
    left = tiled.select(*cols, F.lit(0).alias("side"), F.col("c").alias("i"), other.alias("j"))
    right = tiled.select(*cols, F.lit(1).alias("side"), F.col("c").alias("j"), other.alias("i")).select(*cols, "side", "i", "j")
    both = left.unionByName(right)
    # one hashed key: rows that already lie by component are dealt anew, tile by tile
    got = both.withColumn("tile", F.xxhash64("component", "i", "j")).drop("i", "j").groupBy("tile").applyInArrow(_tiles, "rep long, others long, linked long").groupBy("rep").agg(F.sum("others").alias("others"), F.sum("linked").alias("linked"))
    return members.select("rep", "component").join(got, "rep", "left")


def audit(reps: DataFrame, result: DataFrame) -> float:
    """The lesser mean recall of links, equal vectors counting once, among AUDIT vectors of large components and AUDIT others.

    True links are found by brute force against every vector; vectors without any do not count.
    """
    large = result.groupBy("component").agg((F.count("*") > 2 * K).alias("large"))
    known = reps.join(result.join(large, "component"), "rep", "left").select("rep", "v", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("large", F.lit(False)).alias("large"))
    queries = [q for side in (True, False) for q in known.where(F.col("large") == side).orderBy(F.xxhash64("rep"), "rep").limit(AUDIT).collect()]  # at most 2 AUDIT rows
    if not queries:
        return 1.0
    ids, rows = np.array([q["rep"] for q in queries]), [bytes(q["v"]) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        size = np.array([len(r) for r in rows])
        for batch in batches:
            other, mine = batch.column("v").to_pylist(), batch.column("rep").to_numpy()
            wide = np.array([len(r) for r in other])
            for d in np.unique(size):
                a, b = np.flatnonzero(size == d), np.flatnonzero(wide == d)
                if len(b):
                    x, y = _unit([rows[i] for i in a]), _unit([other[i] for i in b])
                    total[a] += ((x @ y.T >= THRESHOLD) & (ids[a][:, None] != mine[b][None, :])).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["rep", "true_links"])

    truth = {r["rep"]: r["n"] for r in reps.mapInArrow(run, "rep long, true_links long").groupBy("rep").agg(F.sum("true_links").alias("n")).collect()}
    recalls = ([min(1.0, q["linked"] / truth[q["rep"]]) for q in queries if q["large"] == side and truth[q["rep"]]] for side in (True, False))
    return min((sum(r) / len(r) for r in recalls if r), default=1.0)
