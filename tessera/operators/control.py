"""Rate control, reports, link simulation and loss, as ordered folds and windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the controller: target occupancy, base rate, gains, least and greatest rate.
Q_TARGET, R0, KP, KI, R_MIN, R_MAX = 8.0, 40.0, 4.0, 8.0, 4.0, 400.0


def pi_series(reports: DataFrame, kp: float = KP, ki: float = KI) -> DataFrame:
    """Rate and integral after every report (session, ord, q, dt, demand), by one ordered fold a session.

    Saturation is judged with the integral as it was; it stands still when saturated in the error's direction,
    or at rest (nothing to send and room left).
    """
    row = F.struct("ord", F.col("q").cast("double").alias("q"), F.col("dt").cast("double").alias("dt"), "demand")
    g = reports.groupBy("session").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    d = lambda v: F.lit(float(v))
    start = F.struct(d(0).alias("i"), F.expr("cast(array() as array<struct<ord:bigint,rate:double,integral:double>>)").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        e = d(Q_TARGET) - r["q"]
        before = d(R0) + d(kp) * e + d(ki) * acc["i"]
        still = ((before >= R_MAX) & (e > 0)) | ((before <= R_MIN) & (e < 0)) | (~r["demand"] & (e > 0))
        i = F.when(still, acc["i"]).otherwise(acc["i"] + e * r["dt"])
        rate = F.greatest(d(R_MIN), F.least(d(R_MAX), d(R0) + d(kp) * e + d(ki) * i))
        one = F.struct(r["ord"].cast("long").alias("ord"), rate.alias("rate"), i.alias("integral"))
        return F.struct(i.alias("i"), F.concat(acc["out"], F.array(one)).alias("out"))

    out = g.select("session", F.explode(F.aggregate("rows", start, step)["out"]).alias("o"))
    return out.select("session", "o.ord", "o.rate", "o.integral")


def report_dt(reports: DataFrame) -> DataFrame:
    """Seconds since the session's last report: 0.1 for the first, at most 0.5."""
    gap = (F.col("t_ns") - F.lag("t_ns").over(Window.partitionBy("session").orderBy("t_ns", "ord"))) / F.lit(1e9)
    return reports.withColumn("dt", F.coalesce(F.least(F.lit(0.5), gap), F.lit(0.1)))


def settling(series: DataFrame, target: float = Q_TARGET, band: float = 2.0) -> DataFrame:
    return series.groupBy("session").agg(F.max("q").alias("q_max"), F.max(F.when(F.abs(F.col("q") - target) > band, F.col("t"))).alias("settle_t"), F.max_by("q", "t").alias("q_final"))


def jitter(arrivals: DataFrame) -> DataFrame:
    """Smoothed jitter after every arrival (session, ord, t_ms): J += (|delta change| - J) / 16."""
    g = arrivals.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("t_ms").cast("double").alias("t")))).alias("rows"))
    start = F.expr("named_struct('last', cast(null as double), 'delta', cast(null as double), 'j', 0D, 'out', cast(array() as array<struct<ord:bigint,jitter:double>>))")

    def step(acc: Column, r: Column) -> Column:
        delta = r["t"] - acc["last"]
        j = F.when(acc["delta"].isNull() | delta.isNull(), acc["j"]).otherwise(acc["j"] + (F.abs(delta - acc["delta"]) - acc["j"]) / F.lit(16.0))
        return F.struct(r["t"].alias("last"), delta.alias("delta"), j.alias("j"), F.concat(acc["out"], F.array(F.struct(r["ord"].cast("long").alias("ord"), j.alias("jitter")))).alias("out"))

    return g.select("session", F.explode(F.aggregate("rows", start, step)["out"]).alias("o")).select("session", "o.ord", "o.jitter")


def decode_ewma(samples: DataFrame) -> DataFrame:
    """Moving mean of weight 1/8 over (session, ord, ms), and the number in decoding, never under 0."""
    g = samples.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("ms").cast("double").alias("ms"), F.col("d").cast("int").alias("d")))).alias("rows"))
    start = F.expr("named_struct('m', 0D, 'q', 0, 'out', cast(array() as array<struct<ord:bigint,mean:double,queue:int>>))")

    def step(acc: Column, r: Column) -> Column:
        m = F.when(r["d"] < 0, acc["m"] + (r["ms"] - acc["m"]) / F.lit(8.0)).otherwise(acc["m"])
        q = F.greatest(F.lit(0), acc["q"] + r["d"])
        return F.struct(m.alias("m"), q.alias("q"), F.concat(acc["out"], F.array(F.struct(r["ord"].cast("long").alias("ord"), m.alias("mean"), q.alias("queue")))).alias("out"))

    return g.select("session", F.explode(F.aggregate("rows", start, step)["out"]).alias("o")).select("session", "o.ord", "o.mean", "o.queue")


def num_gaps(frames: DataFrame) -> DataFrame:
    """Frames lost before each arrival (session, ord, num), by gaps in the numbers."""
    w = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.max("num").over(w), F.lit(0))
    return frames.withColumn("lost", F.greatest(F.col("num") - last - 1, F.lit(0)).cast("long"))


def occupancy(reports: DataFrame, sends: DataFrame) -> DataFrame:
    """Q = max(0, NUM sent so far - MAX) + COLA at each report, by an as-of merge of sends (session, t_ns, num)."""
    r = reports.select("session", "t_ns", "ord", "max_num", "cola", F.lit(None).cast("long").alias("num"), F.lit(1).alias("kind"))
    s = sends.select("session", "t_ns", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("long").alias("max_num"), F.lit(None).cast("long").alias("cola"), "num", F.lit(0).alias("kind"))
    w = Window.partitionBy("session").orderBy("t_ns", "kind", "ord").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(s).withColumn("sent", F.coalesce(F.max("num").over(w), F.lit(0)))
    return both.where("kind = 1").select("session", "ord", (F.greatest(F.lit(0), F.col("sent") - F.col("max_num")) + F.col("cola")).cast("long").alias("q"))


def link_departures(messages: DataFrame, kb_per_s: int, latency_ms: int = 0) -> DataFrame:
    """Departure of each message (session, ord, now_ns, bytes) of a FIFO link, in closed form; a bandwidth of 0 is no limit.

    With service sums S, the link is free after message i at S_i + max over j <= i of (arrival_j - S_(j-1)).
    """
    service = F.call_function("div", F.col("bytes").cast("long") * 1_000_000, F.lit(kb_per_s).cast("long")) if kb_per_s else F.lit(0).cast("long")
    w = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    m = messages.withColumn("svc", service).withColumn("s", F.sum("svc").over(w))
    m = m.withColumn("free_ns", F.col("s") + F.max(F.col("now_ns") - (F.col("s") - F.col("svc"))).over(w))
    return m.withColumn("out_ns", F.col("free_ns") + latency_ms * 1_000_000).drop("svc", "s")


def turns(queue: DataFrame, after_ms: int = 300) -> DataFrame:
    """Adds ``sent_ns`` to the sends (session, ord, rate, quiet_ms) of a queue that never empties.

    A send leaves a step of 1 / rate after the one before it; without a report for ``after_ms`` the rate is the least.
    """
    rate = F.when(F.col("quiet_ms") > after_ms, F.lit(R_MIN)).otherwise(F.col("rate"))
    step = F.floor(F.lit(1e9) / rate).cast("long")
    w = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return queue.withColumn("sent_ns", F.coalesce(F.sum(step).over(w), F.lit(0)).cast("long"))


class JavaRandom:
    """The 48-bit linear congruential generator whose draws the loss contract fixes."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        v = self.state >> (48 - n)
        return v - (1 << n) if v >> (n - 1) else v

    def below(self, bound: int) -> int:
        r = self.bits(31) & 0x7FFFFFFF
        if bound & (bound - 1) == 0:
            return (bound * r) >> 31
        while r - r % bound + bound - 1 >= 1 << 31:
            r = self.bits(31) & 0x7FFFFFFF
        return r % bound


def random_loss(messages: DataFrame, percent: int, seed: int = 42) -> DataFrame:
    """Marks lost messages; a draw is used only by binary ones, and only when some loss is set."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rng = JavaRandom(seed)
        rows = rows.sort_values("ord", kind="stable")
        lost = [bool(percent > 0 and b and rng.below(100) < percent) for b in rows["is_binary"]]
        return rows[["session", "ord"]].assign(lost=lost)

    return messages.groupBy("session").applyInPandas(fold, "session long, ord long, lost boolean")


def chart_window(points: DataFrame, seconds: int = 30) -> DataFrame:
    """Greatest rate and occupancy over the last seconds of (session, t_s, rate, q)."""
    w = Window.partitionBy("session").orderBy("t_s").rangeBetween(-seconds, 0)
    return points.withColumn("r_top", F.max("rate").over(w)).withColumn("q_top", F.max("q").over(w)).withColumn("n", F.count("*").over(w))


def idle_gaps(events: DataFrame, seconds: int = 30) -> DataFrame:
    gap = F.col("t_s") - F.lag("t_s").over(Window.partitionBy("session").orderBy("t_s", "ord"))
    return events.withColumn("closed", F.coalesce(gap > seconds, F.lit(False)))
