"""Viewport queries: validation, visible tiles, holdings, deadlines, parity groups and delivery."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import TILE, deadline, distance, floor_div
from tessera.functions.hashing import positions_of

MAX_NEW, PROTECTED, GROUP = 295, 16, 4
U32 = 4294967295


def classify(views: DataFrame, n_levels: int) -> DataFrame:
    """Adds ``code``: null for an accepted view, 0 for a stale one, 400 or 416 for an invalid one.

    Only accepted views advance a session's sequence number; staleness is tested first.
    """
    ranges = F.col("x").between(-4096, 2147483647) & F.col("y").between(-4096, 2147483647) & F.col("vw").between(1, 4096) & F.col("vh").between(1, 4096)
    error = F.when(~F.col("seq").between(0, U32) | (F.col("z") < 0), 400).when(F.col("z") >= n_levels, 416).when(~ranges, 400)
    w = Window.partitionBy("session").orderBy("t0", "ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.max(F.when(error.isNull(), F.col("seq"))).over(w), F.lit(-1))
    return views.withColumn("code", F.when(F.col("seq") <= last, 0).otherwise(error).cast("int"))


def visible(views: DataFrame, grid: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles each view (session, seq, t0, z, x, y, vw, vh) shows, with ``dist`` and the centre-out ``rank`` from 0.

    Tiles are generated from the view's bounds, not joined with a tile table; ``grid`` is (z, cols, rows).
    """
    v = views.join(F.broadcast(grid), "z")  # one row a level
    x0, y0 = F.greatest(F.lit(0), floor_div("x", tile)), F.greatest(F.lit(0), floor_div("y", tile))
    x1, y1 = F.least(F.col("cols") - 1, floor_div(F.col("x") + F.col("vw") - 1, tile)), F.least(F.col("rows") - 1, floor_div(F.col("y") + F.col("vh") - 1, tile))
    v = v.withColumn("x0", x0).withColumn("x1", x1).withColumn("y0", y0).withColumn("y1", y1).where("x0 <= x1 and y0 <= y1")
    t = v.withColumn("ty", F.explode(F.sequence("y0", "y1"))).withColumn("tx", F.explode(F.sequence("x0", "x1")))
    t = t.withColumn("dist", distance("tx", "ty", "x", "y", "vw", "vh", tile))
    w = Window.partitionBy("session", "seq").orderBy("dist", "ty", "tx")
    return t.withColumn("rank", F.row_number().over(w) - 1).select("session", "seq", "t0", "z", "tx", "ty", "dist", "rank")


def schedule(tiles: DataFrame) -> DataFrame:
    """Earliest-deadline-first order of each view's new tiles."""
    d = tiles.withColumn("deadline", deadline("t0", "dist"))
    return d.withColumn("turn", F.row_number().over(Window.partitionBy("session", "seq").orderBy("deadline", "rank")))


def parity_groups(scheduled: DataFrame) -> DataFrame:
    """Interleaved groups over the new tiles' ranks, with the parity's deadline 1 ms after the last member's."""
    n = F.least(F.count("*").over(Window.partitionBy("session", "seq")), F.lit(PROTECTED))
    g = scheduled.withColumn("n", n).where((F.col("rank") < PROTECTED) & (F.col("n") >= 2)).withColumn("grp", F.col("rank") % F.ceil(F.col("n") / GROUP))
    out = g.groupBy("session", "seq", "grp").agg(F.count("*").alias("members"), F.max("deadline").alias("last"), F.min("rank").alias("first_rank"))
    return out.where("members >= 2").select("session", "seq", F.col("grp").cast("long").alias("grp"), "members", "first_rank", (F.col("last") + 1_000_000).alias("deadline"))


def contains(z_bits: Column, h1: Column, h2: Column) -> Column:
    """Filter membership: every position is among the set bits (array<int>)."""
    return F.size(F.array_except(positions_of(h1, h2), z_bits)) == 0


def holdings_filter(held: DataFrame, keys: list[str]) -> DataFrame:
    """Set bits of each key's filter from rows with ``positions``."""
    found = held.select(*keys, F.explode("positions").alias("bit")).groupBy(*keys).agg(F.array_sort(F.collect_set("bit")).alias("bits"))
    return found.withColumn("popcount", F.size("bits").cast("long"))


def bitmap(bits: DataFrame, keys: list[str]) -> DataFrame:
    """512-byte bitmaps, least significant bit first, from rows (keys, bit)."""
    byte = bits.distinct().groupBy(*keys, F.floor(F.col("bit") / 8).alias("at")).agg(F.sum(F.pow(F.lit(2), F.col("bit") % 8).cast("long")).alias("v"))
    m = byte.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("int").alias("k"), "v"))).alias("m"))
    hexes = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0))), 2, "0"))
    return m.select(*keys, F.unhex(F.array_join(hexes, "")).alias("bitmap"))


def nearest_ancestor(missing: DataFrame, cached: DataFrame, depth: int) -> DataFrame:
    """The nearest cached ancestor of each missing tile (session, z, x, y)."""
    up = missing.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(depth)))).where("z >= k")
    up = up.withColumn("az", F.col("z") - F.col("k")).withColumn("ax", F.expr("shiftright(x, k)")).withColumn("ay", F.expr("shiftright(y, k)"))
    have = cached.select("session", F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay")).distinct()
    hit = up.join(have, ["session", "az", "ax", "ay"])
    best = hit.groupBy("session", "z", "x", "y").agg(F.max_by(F.struct("az", "ax", "ay"), "az").alias("a"))
    return missing.join(best, ["session", "z", "x", "y"], "left").select("session", "z", "x", "y", "a.az", "a.ax", "a.ay")


def _xor(table: pa.Table) -> pa.Table:
    """XOR of the payloads of each group of one bucket."""
    out: dict[int, np.ndarray] = {}
    for k, p in zip(table.column("key").to_pylist(), table.column("payload"), strict=True):
        p = np.frombuffer(p.as_buffer(), np.uint8)
        have = out.get(k)
        if have is None or len(have) < len(p):
            out[k] = np.concatenate((have, np.zeros(len(p) - len(have), np.uint8))) if have is not None else np.zeros(len(p), np.uint8)
        out[k][: len(p)] ^= p
    return pa.table([pa.array(list(out), pa.int64()), pa.array([v.tobytes() for v in out.values()], pa.binary())], names=["key", "parity"])


def parity_bytes(members: DataFrame, key: str, buckets: int = 512) -> DataFrame:
    """XOR of each group's payloads, padded with zeros to the longest; a group has GROUP members at most.

    Groups are dealt to buckets, so that a call of Python serves many.
    """
    rows = members.select(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).alias("bucket"), F.col(key).cast("long").alias("key"), "payload").where("payload is not null")
    return rows.groupBy("bucket").applyInArrow(_xor, "key long, parity binary").withColumnRenamed("key", key)


DELIVERY = "session long, seq long, kind string, z int, tx long, ty long, grp long, dist double, rank long, deadline long, turn long, sent_ns long, sent boolean, late boolean"
NEVER = (1 << 63) - 1


def _delivered(rate: float):
    gap = int(1e9 / rate)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, slot, out, now_in = set(), 0, [], None
        rows = rows.sort_values(["session", "seq", "rank"], kind="stable")
        new = np.diff(rows["seq"].to_numpy(), prepend=-1) != 0
        new |= np.diff(rows["session"].to_numpy(), prepend=-1) != 0
        edges = np.append(np.flatnonzero(new), len(rows))
        cols = [rows[c].tolist() for c in ("session", "seq", "t0", "next_t0", "z", "tx", "ty", "dist", "deadline")]
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            session, seq, t0, until = (c[x] for c in cols[:4])
            if session != now_in:
                held, slot, now_in = set(), 0, session
            until = NEVER if until != until or until is None else int(until)
            tiles = [(int(z), int(tx), int(ty), d, int(due)) for z, tx, ty, d, due in zip(*(c[x:y] for c in cols[4:]), strict=True) if tx == tx and tx is not None]
            fresh = [t for t in tiles if t[:3] not in held][:MAX_NEW]
            jobs = [(t[4], r, "tile", t, None, r) for r, t in enumerate(fresh)]
            n = min(len(fresh), PROTECTED)
            n_groups = -(-n // GROUP) if n > 1 else 0
            jobs += [(max(t[4] for t in fresh[g:n:n_groups]) + 1_000_000, MAX_NEW + g, "parity", None, g, None) for g in range(n_groups)]
            jobs = sorted(jobs, key=lambda j: j[:2]) + [(NEVER, 0, "done", None, None, None)]
            now = max(t0, slot)
            for turn, (due, _, kind, tile, grp, rank) in enumerate(jobs, 1):
                sent = now < until
                out.append((session, seq, kind, *(tile[:3] if tile else (None,) * 3), grp, tile[3] if tile else None, rank, due, turn, now, sent, sent and now > due))
                if sent and kind == "tile":
                    held.add(tile[:3])
                if sent and kind != "done":
                    slot = now + gap
                now += gap
        return pd.DataFrame(out, columns=[c.split()[0] for c in DELIVERY.split(", ")]).astype({c: "Int64" for c in ("tx", "ty", "grp", "rank")} | {"z": "Int32"})

    return run


def deliver(views: DataFrame, tiles: DataFrame, rate: float) -> DataFrame:
    """Every request (tile, parity, done) of every accepted view, in one ordered fold a session.

    A session holds a tile once it was sent, so a view asks for its visible tiles less those, at most MAX_NEW from the
    centre out; with their parities and the closing DONE they are one queue by deadline. The queue leaves at ``rate``
    a second, the next turn a step after the last send; the session's next view clears what is left. ``views`` is
    (session, seq, t0, next_t0), ``tiles`` what ``visible`` gives for them; a view without any still ends with DONE.
    """
    t = tiles.select("session", "seq", "z", "tx", "ty", "dist", "rank", deadline("t0", "dist").alias("deadline"))
    rows = views.select("session", "seq", "t0", "next_t0").join(t, ["session", "seq"], "left")
    # sessions are dealt to buckets, so that a call of Python serves many
    n = 4 * int(views.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.groupBy(F.pmod(F.xxhash64("session"), F.lit(n))).applyInPandas(_delivered(rate), DELIVERY)
