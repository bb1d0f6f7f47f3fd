"""Arrival streams: quiet periods, fingerprints and live session state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quiet_periods(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Islands of arrivals (path, ts) with no gap of ``seconds`` or more: start, end and when the file may be taken."""
    w = Window.partitionBy("path").orderBy("ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(w)
    e = events.withColumn("isle", F.sum(F.coalesce((gap >= seconds * 1_000_000).cast("int"), F.lit(1))).over(w))
    return e.groupBy("path", "isle").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))


def live_quiet_periods(stream: DataFrame, seconds: int = 5) -> DataFrame:
    """The same over a stream, by session windows on event time."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{seconds} seconds")
    return s.groupBy("path", F.session_window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n_events")).select("path", F.col("w.start").alias("first_ts"), F.col("w.end").alias("ready_ts"), "n_events")


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, size, mtime) whose fingerprint has not been ingested."""
    return files.join(seen, ["path", "size", "mtime"], "left_anti")


#: (state, command) -> state; what is missing is refused with 412.
SESSION = {("CONNECTED", "HELLO"): "READY", ("READY", "LIST"): "READY", ("IMAGE_OPEN", "LIST"): "IMAGE_OPEN", ("READY", "OPEN"): "IMAGE_OPEN", ("IMAGE_OPEN", "OPEN"): "IMAGE_OPEN", ("READY", "RESUME"): "IMAGE_OPEN"} | {("IMAGE_OPEN", c): "IMAGE_OPEN" for c in ("VIEWPORT", "CANCEL", "REPORT", "BLOOM")} | {(s, "SIM"): s for s in ("READY", "IMAGE_OPEN")}
COMMANDS = {c for _, c in SESSION}


def _step(state: str, cmd: str) -> tuple[str, int]:
    if cmd not in COMMANDS:
        return state, 400
    to = SESSION.get((state, cmd))
    return (to, 0) if to else (state, 412)


def live_session_states(stream: DataFrame) -> DataFrame:
    """State and error after each message (session, ord, cmd) of a stream, with one keyed state a session."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else "CONNECTED"
        out = []
        for r in pd.concat(list(batches)).sort_values("ord", kind="stable").itertuples():
            state, code = _step(state, r.cmd)
            out.append((key[0], r.ord, state, code))
        kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=["session", "ord", "state", "code"])

    return stream.groupBy("session").applyInPandasWithState(fold, "session long, ord long, state string, code int", "s string", "append", GroupStateTimeout.NoTimeout)
