"""Session mechanics over message logs: states and outcomes, snapshots of holdings, receivers, pacing, client behaviour."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import messages as M
from tessera.operators.viewport import parity_bytes

#: Protocol version, and the commands by the states that allow them.
VERSION = 2
OPENING = ("OPEN", "RESUME")
WHEN_OPEN = ("VIEWPORT", "BLOOM", "CANCEL", "REPORT")
WHEN_READY = ("LIST", "SIM", *OPENING)


def outcomes(log: DataFrame, catalog: DataFrame, simulated: bool = False) -> DataFrame:
    """Adds ``state`` (after the message), ``code`` (0 or the error), ``closes`` and ``segment`` to a log of messages.

    ``log``: session, ord, cmd (null for a binary frame), version, cache, img. ``catalog``: img, status. States only go
    on from CONNECTED to READY to IMAGE_OPEN to CLOSED, so each is known from running maxima; segment counts the images
    opened, and sequence numbers run on across them. Messages after a close are left out.
    """
    m = log.join(catalog.select("img", "status"), "img", "left")
    cmd, before = F.col("cmd"), Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ever = lambda c: F.coalesce(F.max(c).over(before), F.lit(False))
    hello, fits = cmd == "HELLO", F.col("cache").between(1, 1_000_000)
    m = m.withColumn("_ready", ever(F.coalesce(hello & (F.col("version") == VERSION) & fits, F.lit(False))))
    m = m.withColumn("_opens", F.coalesce(F.col("_ready") & cmd.isin(*OPENING) & (F.col("status") == "READY"), F.lit(False))).withColumn("_open", ever(F.col("_opens")))
    m = m.withColumn("closes", F.when(cmd.isNull(), 1003).when(hello & ~F.col("_ready") & (F.col("version") != VERSION), 1002))
    m = m.withColumn("_gone", ever(F.col("closes").isNotNull())).where("not _gone")
    found = F.when(F.col("status").isin("PROCESSING", "FAILED"), 409).when(F.col("status") == "UNREADABLE", 500).when(F.col("status").isNull(), 404).otherwise(0)
    opened = F.col("_opens") & ((cmd == "OPEN") | ~F.col("_open"))
    code = (
        F.when(cmd.isNull(), 0)
        .when(~cmd.isin("HELLO", *WHEN_READY, *WHEN_OPEN), 400)
        .when(hello, F.when(F.col("_ready"), 412).when(F.col("version") != VERSION, 426).when(~fits, 400).otherwise(0))
        .when(~F.col("_ready") | (cmd.isin(*WHEN_OPEN) & ~F.col("_open")) | ((cmd == "RESUME") & F.col("_open")), 412)
        .when((cmd == "SIM") & F.lit(not simulated), 403)
        .when(cmd.isin(*OPENING), found)
        .otherwise(0)
    )
    m = m.withColumn("code", code.cast("int")).withColumn("segment", F.sum(opened.cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(F.col("closes").isNotNull(), "CLOSED").when(F.col("segment") > 0, "IMAGE_OPEN").when(F.col("_ready") | (hello & (F.col("code") == 0)), "READY").otherwise("CONNECTED")
    return m.withColumn("state", state).drop("_ready", "_opens", "_open", "_gone")


def snapshots(log: DataFrame) -> DataFrame:
    """(session, ord, forgotten, remain) for every snapshot of a log (session, ord, kind, key, num, max).

    kind is send, snapshot or open. A send is remembered until its key is sent again, a snapshot covers its number, or an
    image is opened. Which snapshot that is follows from one window in order of numbers, so nothing is compared in pairs.
    """
    by = Window.partitionBy("session")
    sends = F.col("kind") == "send"
    log = log.withColumn("_open", F.min(F.when(F.col("kind") == "open", F.col("ord"))).over(by.orderBy("ord").rowsBetween(1, Window.unboundedFollowing)))
    log = log.withColumn("_again", F.when(sends, F.lead("ord").over(Window.partitionBy("session", "kind", "key").orderBy("ord"))))
    log = log.withColumn("_value", F.when(sends, F.col("num")).when(F.col("kind") == "snapshot", F.col("max")).otherwise(-1))
    log = log.withColumn("_covered", F.min(F.when(F.col("kind") == "snapshot", F.col("ord"))).over(by.orderBy("_value").rangeBetween(0, Window.unboundedFollowing)))
    end = F.least("_open", "_again", "_covered")
    ends = log.where(sends).select("session", end.alias("ord"), F.lit(-1).alias("d"), (end == F.col("_covered")).cast("int").alias("f")).where("ord is not null")
    steps = log.select("session", "ord", F.when(sends, 1).otherwise(0).alias("d"), F.lit(0).alias("f")).unionByName(ends)
    steps = steps.groupBy("session", "ord").agg(F.sum("d").alias("d"), F.sum("f").alias("forgotten")).withColumn("remain", F.sum("d").over(by.orderBy("ord")))
    return log.where("kind = 'snapshot'").select("session", "ord").join(steps, ["session", "ord"]).select("session", "ord", "forgotten", "remain")


def verdicts(frames: DataFrame, first_seq: int) -> DataFrame:
    """Adds ``verdict`` to received frames (session, ord, frame): short, version, type, length, stale, crc or ok.

    Loss by gaps of NUM is told before the type, so ``counted`` marks the frames whose number counts.
    """
    f = frames.withColumn("f", M.read_tile_frame("frame")).withColumn("_n", F.length("frame"))
    bad = F.when(F.col("_n") < 28, "short").when(F.col("f.ver") != VERSION, "version").when(F.col("f.kind") != 1, "type")
    bad = bad.when(~F.col("f.fmt").isin(1, 2) | (F.col("f.len") + 28 != F.col("_n")), "length").when(F.col("f.seq") < first_seq, "stale").when(F.crc32("f.data") != F.col("f.crc"), "crc").otherwise("ok")
    return f.withColumn("verdict", bad).withColumn("counted", ~F.col("verdict").isin("short", "version")).drop("_n")


def counters(frames: DataFrame, first_seq: int) -> DataFrame:
    """Per session: frames, bytes, tiles, bad_crc, dropped and lost, from the frames' bytes."""
    v = verdicts(frames, first_seq)
    w = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("counted"), F.col("f.num"))
    v = v.withColumn("_lost", F.when(F.col("counted"), F.greatest(F.lit(0), F.col("f.num") - F.coalesce(F.max(seen).over(w), F.lit(0)) - 1)).otherwise(0))
    g = v.groupBy("session").agg(F.count("*").alias("frames"), F.sum(F.length("frame")).alias("bytes"), F.count_if(F.col("verdict") == "ok").alias("tiles"), F.count_if(F.col("verdict") == "crc").alias("bad_crc"), F.count_if(~F.col("verdict").isin("ok", "crc")).alias("dropped"), F.sum("_lost").alias("lost"))
    return g


_PARITY = "grp long, verdict string, parity binary, members array<struct<z:int,x:long,y:long,len:long,mcrc:long>>"
#: Layout and size of one member in a parity frame.
_MEMBER, _SIZE = ">BIIBII", 18


def _parity_frames(first_seq: int):
    def parse(frame: memoryview) -> tuple[str | None, bytes | None, list | None]:
        """Error of a parity frame, or its parity and members."""
        if len(frame) < 11 or int.from_bytes(frame[2:6], "big") < first_seq:
            return "dropped", None, None
        k = frame[10]
        body = 11 + _SIZE * k
        if not 2 <= k <= 4 or len(frame) < body + 8:
            return "dropped", None, None
        size, crc = struct.unpack_from(">II", frame, body)
        parity = bytes(frame[body + 8 :])
        if len(parity) != size:
            return "dropped", None, None
        if zlib.crc32(parity) != crc:
            return "bad_crc", None, None
        found = (struct.unpack_from(_MEMBER, frame, 11 + _SIZE * i) for i in range(k))
        return None, parity, [{"z": z, "x": x, "y": y, "len": n, "mcrc": c} for z, x, y, _, n, c in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("len", pa.int64()), ("mcrc", pa.int64())]))
        for batch in batches:
            got = [parse(memoryview(v.as_buffer())) for v in batch.column("frame")]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], kind)], ["grp", "verdict", "parity", "members"])

    return run


def recover(frames: DataFrame, tiles: DataFrame, first_seq: int) -> DataFrame:
    """(grp, outcome, payload) of received parity frames (grp, frame) against the tiles at hand (z, x, y, payload).

    outcome: dropped (stale, group size, length), bad_crc, unneeded, irrecoverable, crc or recovered; payload is the tile won.
    """
    f = frames.select(F.col("grp").cast("long").alias("grp"), "frame").mapInArrow(_parity_frames(first_seq), _PARITY)
    m = f.where("verdict is null").select("grp", F.explode("members").alias("m")).select("grp", "m.*")
    m = m.join(tiles.select("z", "x", "y", "payload"), ["z", "x", "y"], "left")
    missing = m.groupBy("grp").agg(F.count_if(F.col("payload").isNull()).alias("missing"), F.max(F.when(F.col("payload").isNull(), F.struct("len", "mcrc"))).alias("lost"))
    one = missing.where("missing = 1").select("grp")
    xor = parity_bytes(m.where("payload is not null").select("grp", "payload").unionByName(f.where("verdict is null").select("grp", F.col("parity").alias("payload"))).join(one, "grp", "left_semi"), "grp")
    won = missing.where("missing = 1").join(xor, "grp").select("grp", F.substr("parity", F.lit(1), F.col("lost.len").cast("int")).alias("payload"), "lost.mcrc")
    out = f.select("grp", "verdict").join(missing.select("grp", "missing"), "grp", "left").join(won, "grp", "left")
    fine = F.crc32("payload") == F.col("mcrc")
    outcome = F.coalesce("verdict", F.when(F.col("missing") == 0, "unneeded").when(F.col("missing") > 1, "irrecoverable").when(fine, "recovered").otherwise("crc"))
    return out.select("grp", outcome.alias("outcome"), F.when(fine, F.col("payload")).alias("payload"))


def as_of(rows: DataFrame, config: DataFrame, values: list[str]) -> DataFrame:
    """Each row (session, ord, ...) with the values of its session's last configuration before it; null before the first."""
    both = rows.withColumn("_kind", F.lit(1)).unionByName(config.select("session", "ord", F.lit(0).alias("_kind"), F.struct(*values).alias("_set")), allowMissingColumns=True)
    w = Window.partitionBy("session").orderBy("ord", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_set", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select(*rows.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def attempts(files: DataFrame) -> DataFrame:
    """(path, ord, taken) of arrivals (path, ord, fingerprint, ok): false where the fingerprint is that of the last ingest.

    A failed ingest is forgotten, so the same file is taken again. After any arrival the last ingest is of its
    fingerprint or forgotten; so in a run of equal fingerprints all are taken up to the first that goes well, and each
    follows from windows. A null fingerprint is as good as forgotten: it is taken only where another one was kept.
    """
    by = Window.partitionBy("path").orderBy("ord", "fingerprint", "ok")
    was = F.lag("fingerprint").over(by)
    f = files.withColumn("_first", F.coalesce(~F.col("fingerprint").eqNullSafe(was) | (F.row_number().over(by) == 1), F.lit(True)))
    f = f.withColumn("_run", F.sum(F.col("_first").cast("long")).over(by))
    run = Window.partitionBy("path", "_run").orderBy("ord", "fingerprint", "ok").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("_kept", F.col("fingerprint").isNotNull() & F.coalesce(F.max("ok").over(run), F.lit(False)))
    f = f.withColumn("_before", F.coalesce(F.lag("_kept").over(by), F.lit(False)))
    taken = F.when(F.col("fingerprint").isNull(), F.col("_before") & F.col("_first")).otherwise(F.col("_first") | ~F.col("_before"))
    return f.select("path", F.col("ord").cast("long").alias("ord"), taken.alias("taken"))


def last_tiles(arrivals: DataFrame, keep: int = 32) -> DataFrame:
    """The ``keep`` keys of each session (session, num, key) that arrived last; an arrival again moves a key to the end."""
    last = arrivals.groupBy("session", "key").agg(F.max("num").alias("num"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("num")))).where(F.col("place") <= keep)


def throttled(views: DataFrame, step_ms: int = 100) -> DataFrame:
    """Views (session, ord, t_ms, signature) that a client declares: changed ones, the last of each step."""
    changed = views.withColumn("_was", F.lag("signature").over(Window.partitionBy("session").orderBy("t_ms", "ord"))).where(~F.col("signature").eqNullSafe(F.col("_was")))
    w = Window.partitionBy("session", F.floor(F.col("t_ms") / step_ms)).orderBy(F.desc("t_ms"), F.desc("ord"))
    return changed.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "_was")
