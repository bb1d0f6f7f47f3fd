"""Replacement policies replayed over access traces (trace, ord, op, key, bytes).

``op`` is "get" (a use; a miss stores the item) or "peek" (a look that stores nothing and is neither hit nor miss).
ARC is sequential by nature, so each trace is folded in order; a trace's accesses go to one task, the traces
to all. LRU over items of fixed size also has a relational form, by stack distance.
"""

from __future__ import annotations

from collections import OrderedDict, deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Lru:
    """Byte-bounded; peeking refreshes recency; an item above the bound is not stored."""

    def __init__(self, limit: int):
        self.limit, self.items, self.used = limit, OrderedDict(), 0

    def get(self, key: str) -> bool:
        if key not in self.items:
            return False
        self.items.move_to_end(key)
        return True

    peek = get

    def put(self, key: str, size: int) -> None:
        if size > self.limit:
            return
        self.used += size - self.items.pop(key, 0)
        self.items[key] = size
        while self.used > self.limit:
            self.used -= self.items.popitem(last=False)[1]


class Arc:
    """Adaptive replacement (Megiddo and Modha) bounded in bytes: one table of items, each with its tier, size and stamp.

    Tiers 0 and 1 are kept items used once and again, 2 and 3 what is remembered of evicted ones. An item that
    comes back from memory moves the target of tier 0 by its size times the ratio of the memories' counts, at
    least 1. Room is made after storing: first by eviction, then by forgetting the oldest of tier 2 over the bound and
    of tier 3 over twice the bound in all. A tier's queue keeps outdated stamps, which are skipped at its head.
    """

    def __init__(self, limit: int):
        self.limit, self.target, self.clock = limit, 0, 0
        self.items: dict[str, tuple[int, int, int]] = {}
        self.queues = [deque() for _ in range(4)]
        self.bytes, self.count = [0] * 4, [0] * 4

    def _place(self, key: str, tier: int | None, size: int | None = None) -> None:
        """Moves an item to the end of a tier, or out of the table."""
        if key in self.items:
            old, had, _ = self.items.pop(key)
            self.bytes[old] -= had
            self.count[old] -= 1
            size = had if size is None else size
        if tier is not None:
            self.clock += 1
            self.items[key] = tier, size, self.clock
            self.queues[tier].append((key, self.clock))
            self.bytes[tier] += size
            self.count[tier] += 1

    def _oldest(self, tier: int) -> str:
        queue = self.queues[tier]
        while True:
            key, stamp = queue[0]
            if key in self.items and self.items[key][2] == stamp:
                return key
            queue.popleft()

    def peek(self, key: str) -> bool:
        return self.items.get(key, (4,))[0] < 2

    def get(self, key: str) -> bool:
        hit = self.peek(key)
        if hit:
            self._place(key, 1)
        return hit

    def put(self, key: str, size: int) -> None:
        tier = self.items.get(key, (4,))[0]
        if tier < 2 or size > self.limit:
            return
        if tier < 4:
            step = int(size * max(1.0, self.count[5 - tier] / self.count[tier]))
            self.target = max(0, min(self.limit, self.target + (step if tier == 2 else -step)))
        self._place(key, 0 if tier == 4 else 1, size)
        least = self.target + (0 if tier == 3 else 1)  # bytes of tier 0 from which on it gives way
        while self.bytes[0] + self.bytes[1] > self.limit:
            gives = self.count[0] and (self.bytes[0] >= least or not self.count[1])
            self._place(self._oldest(0 if gives else 1), 2 if gives else 3)
        while self.count[2] and self.bytes[0] + self.bytes[2] > self.limit:
            self._place(self._oldest(2), None)
        while self.count[3] and sum(self.bytes) > 2 * self.limit:
            self._place(self._oldest(3), None)


POLICIES = {"lru": Lru, "arc": Arc}


def replay(trace: DataFrame, policy: str, limit: int) -> DataFrame:
    """(trace, ord, op, key, hit) of every access under a policy."""
    make = POLICIES[policy]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        cache, hits = make(limit), []
        rows = rows.sort_values("ord", kind="stable")
        for op, key, size in zip(rows["op"], rows["key"], rows["bytes"], strict=True):
            if op == "peek":
                hits.append(cache.peek(key))
                continue
            hit = cache.get(key)
            if not hit:
                cache.put(key, int(size))
            hits.append(hit)
        return rows[["trace", "ord", "op", "key"]].assign(hit=hits)

    return trace.groupBy("trace").applyInPandas(fold, "trace string, ord long, op string, key string, hit boolean")


def hit_rates(replayed: DataFrame) -> DataFrame:
    uses = F.col("op") != "peek"
    out = replayed.groupBy("trace").agg(F.count_if(uses & F.col("hit")).alias("hits"), F.count_if(uses & ~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return out.withColumn("hit_pct", F.when(total > 0, 100.0 * F.col("hits") / total).otherwise(F.lit(0.0)))


def lru_by_distance(trace: DataFrame, limit: int) -> DataFrame:
    """LRU hits by stack distance: an access hits when the distinct keys since its key's last use, itself included, fit.

    Sizes are fixed by key. For each access the keys in between are those whose next use lies after it, so the
    join keeps one row a key and gap.
    """
    by_key = Window.partitionBy("trace", "key").orderBy("ord")
    t = trace.withColumn("prev", F.lag("ord").over(by_key)).withColumn("next", F.lead("ord").over(by_key))
    a = t.select("trace", F.col("ord").alias("o"), F.col("prev").alias("p"), F.col("key").alias("k"), F.col("bytes").alias("own"))
    b = t.select("trace", "ord", "next", "bytes")
    gap = a.where("p is not null").join(b, "trace").where("ord > p and ord < o and (next is null or next >= o)").groupBy("trace", "o").agg(F.sum("bytes").alias("between"))
    out = a.join(gap, ["trace", "o"], "left")
    return out.select("trace", F.col("o").alias("ord"), F.col("k").alias("key"), (F.col("p").isNotNull() & (F.coalesce("between", F.lit(0)) + F.col("own") <= limit)).alias("hit"))
