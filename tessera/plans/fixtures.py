"""Relations derived from the driver's tables: rasters, tiles, views, accesses, reports, messages and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _grey(e):
    return F.floor((e.cast("double") + 1.0) * 127.5).cast("int")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors as the rows of a grey image of 64 columns, in bands (img, x0, y0, width, data)."""
    e = table(spark, sf, "embeddings").where("embedding is not null")
    return e.select(F.lit(0).alias("img"), F.lit(0).cast("long").alias("x0"), F.col("vec_id").alias("y0"), F.lit(64).alias("width"), F.transform("embedding", _grey).alias("data"))


def lines_rgb(spark: SparkSession, sf: str) -> DataFrame:
    """The same as an image of 21 columns in three channels."""
    pixel = lambda x: F.array(*[_grey(F.get("embedding", x + i)) for i in (0, 21, 42)])
    e = table(spark, sf, "embeddings").where("embedding is not null")
    return e.select(F.lit(0).alias("img"), F.lit(0).cast("long").alias("x0"), F.col("vec_id").alias("y0"), F.lit(21).alias("width"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(20)), pixel)).alias("data"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """(session, n, t0, event_id, event_type, value): events in order within their user."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t0"))
    return e.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("t0", "event_id")).cast("long"))


EVENTS_SQL = """ev AS (SELECT user_id AS session, event_id, event_type, value, epoch_us(ts) * 1000 AS t0,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""

SIDE, LEVELS = 5775, 6


def grid(spark: SparkSession) -> DataFrame:
    rows = []
    for z in range(LEVELS):
        w = -(-SIDE // (1 << (LEVELS - 1 - z)))
        rows.append((z, -(-w // 256), -(-w // 256), w))
    return spark.createDataFrame(rows, "z int, cols long, rows long, w long")


GRID_SQL = f"""grid AS (SELECT z::INT AS z, (({SIDE} + (1 << ({LEVELS - 1} - z)) - 1) // (1 << ({LEVELS - 1} - z)))::BIGINT AS w,
  ((({SIDE} + (1 << ({LEVELS - 1} - z)) - 1) // (1 << ({LEVELS - 1} - z))) + 255) // 256 AS cols FROM range({LEVELS}) t(z))"""


def views(spark: SparkSession, sf: str) -> DataFrame:
    """Views over a square pyramid, 50 ms to 3 s apart, some stale, some out of range, some with negative origin."""
    e = events(spark, sf)
    i = F.col("event_id")
    z = F.when(i % 29 == 0, 9).otherwise(i % LEVELS).cast("int")
    clock = F.sum(50_000_000 + i * 7919 % 3000 * 1_000_000).over(Window.partitionBy("session").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("t0", clock).select("session", F.col("n").alias("ord"), F.when(i % 17 == 0, F.col("n") - 2).otherwise(F.col("n")).alias("seq"), "t0", z.alias("z"), (i * 37 % 3000 - 300).alias("x"), (i * 53 % 3000 - 100).alias("y"), F.when(i % 23 == 0, 5000).otherwise(200 + i % 900).alias("vw"), (150 + i % 700).alias("vh"))


VIEWS_SQL = f"""{EVENTS_SQL}, {GRID_SQL},
views AS (SELECT session, n AS ord, CASE WHEN event_id % 17 = 0 THEN n - 2 ELSE n END AS seq, (sum(50000000 + event_id * 7919 % 3000 * 1000000) OVER (PARTITION BY session ORDER BY n))::BIGINT AS t0, CASE WHEN event_id % 29 = 0 THEN 9 ELSE event_id % {LEVELS} END::INT AS z,
  event_id * 37 % 3000 - 300 AS x, event_id * 53 % 3000 - 100 AS y, CASE WHEN event_id % 23 = 0 THEN 5000 ELSE 200 + event_id % 900 END AS vw, 150 + event_id % 700 AS vh FROM ev),
ranged AS (SELECT *, CASE WHEN seq NOT BETWEEN 0 AND 4294967295 OR z < 0 THEN 400 WHEN z >= {LEVELS} THEN 416
  WHEN NOT (x BETWEEN -4096 AND 2147483647 AND y BETWEEN -4096 AND 2147483647 AND vw BETWEEN 1 AND 4096 AND vh BETWEEN 1 AND 4096) THEN 400 END AS err FROM views),
coded AS (SELECT *, CASE WHEN seq <= coalesce(max(CASE WHEN err IS NULL THEN seq END) OVER (PARTITION BY session ORDER BY t0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 0 ELSE err END::INT AS code FROM ranged)"""

VISIBLE_SQL = (
    VIEWS_SQL
    + """,
boxed AS (SELECT session, seq, t0, coded.z, x, y, vw, vh, greatest(0, floor(x / 256.0))::BIGINT AS x0, least(cols - 1, floor((x + vw - 1) / 256.0))::BIGINT AS x1,
  greatest(0, floor(y / 256.0))::BIGINT AS y0, least(cols - 1, floor((y + vh - 1) / 256.0))::BIGINT AS y1 FROM coded JOIN grid ON coded.z = grid.z WHERE code IS NULL),
tall AS (SELECT *, unnest(range(y0, y1 + 1)) AS ty FROM boxed),
wide AS (SELECT *, unnest(range(x0, x1 + 1)) AS tx FROM tall),
dists AS (SELECT *, sqrt(((tx + 0.5::DOUBLE) * 256 - (x + vw / 2.0::DOUBLE)) * ((tx + 0.5::DOUBLE) * 256 - (x + vw / 2.0::DOUBLE)) + ((ty + 0.5::DOUBLE) * 256 - (y + vh / 2.0::DOUBLE)) * ((ty + 0.5::DOUBLE) * 256 - (y + vh / 2.0::DOUBLE))) / 256 AS dist FROM wide),
vis AS (SELECT session, seq, t0, z, tx, ty, dist, row_number() OVER (PARTITION BY session, seq ORDER BY dist, ty, tx) - 1 AS rank FROM dists)"""
)
#: Deliveries by recursion over a session's views: what is held, when the next turn is, and each view's queue.
DELIVERY_SQL = (
    VISIBLE_SQL
    + """,
okv AS (SELECT session, seq, t0, row_number() OVER w AS k, lead(t0) OVER w AS next_t0 FROM coded WHERE code IS NULL WINDOW w AS (PARTITION BY session ORDER BY seq)),
lists AS (SELECT session, seq, list({'d': t0 + 30000000 + floor(25e6::DOUBLE * dist + 0.5)::BIGINT, 'key': z * 1000000 + ty * 1000 + tx, 'dist': dist} ORDER BY rank) AS ts FROM vis GROUP BY 1, 2),
vw AS (SELECT okv.*, coalesce(ts, []) AS ts FROM okv LEFT JOIN lists USING (session, seq)),
rec(session, k, seq, t0, next_t0, held, slot, q, t1, m) AS (
  SELECT session, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], 0::BIGINT, []::STRUCT(d BIGINT, o BIGINT, key BIGINT, dist DOUBLE)[], 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT session FROM vw)
  UNION ALL
  SELECT session, k, seq, t0, next_t0, list_concat(held, list_transform(list_filter(q[1:m], lambda j: j.key >= 0), lambda j: j.key)), CASE WHEN least(m, len(q)) > 0 THEN t1 + least(m, len(q)) * 25000000 ELSE slot END, q, t1, m FROM (
    SELECT *, CASE WHEN next_t0 IS NULL THEN len(q) + 1 ELSE greatest(0, least(len(q) + 1, ceil((next_t0 - t1) / 25000000.0::DOUBLE)::BIGINT)) END AS m FROM (
      SELECT session, k, seq, t0, next_t0, held, slot, greatest(t0, slot) AS t1, list_sort(list_concat(
          list_transform(range(1, n + 1), lambda i: {'d': fresh[i].d, 'o': i, 'key': fresh[i].key::BIGINT, 'dist': fresh[i].dist}),
          list_transform(range(0, g), lambda j: {'d': list_max(list_transform(list_filter(range(0, p), lambda i: i % g = j), lambda i: fresh[i + 1].d)) + 1000000, 'o': 1000 + j, 'key': -1 - j, 'dist': NULL::DOUBLE}))) AS q FROM (
        SELECT *, len(fresh) AS n, least(len(fresh), 16) AS p, CASE WHEN len(fresh) > 1 THEN (least(len(fresh), 16) + 3) // 4 ELSE 0 END AS g FROM (
          SELECT v.session, v.k, v.seq, v.t0, v.next_t0, r.held, r.slot, list_filter(v.ts, lambda t: NOT list_contains(r.held, t.key))[1:295] AS fresh FROM rec r JOIN vw v ON v.session = r.session AND v.k = r.k + 1))))),
done AS (SELECT session, seq, t0, next_t0, t1 + len(q) * 25000000 AS sent_ns, m > len(q) AS sent FROM rec WHERE k > 0),
req AS (SELECT session, seq, t0, u.d AS deadline, u.o AS o, u.key AS key, u.dist AS dist, turn, t1 + (turn - 1) * 25000000 AS sent_ns, turn <= m AS sent, turn <= m AND t1 + (turn - 1) * 25000000 > u.d AS late
  FROM (SELECT session, seq, t0, t1, m, unnest(q) AS u, unnest(range(1, len(q) + 1)) AS turn FROM rec WHERE k > 0))"""
)
NEW_SQL = (
    DELIVERY_SQL
    + """,
news AS (SELECT session, seq, t0, (key // 1000000)::INT AS z, key % 1000 AS tx, key // 1000 % 1000 AS ty, dist, o - 1 AS rank, deadline FROM req WHERE key >= 0),
sched AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY deadline, rank) AS turn FROM news)"""
)
PARITY_SQL = (
    NEW_SQL
    + """,
ngrp AS (SELECT *, least(count(*) OVER (PARTITION BY session, seq), 16) AS n FROM sched),
grouped AS (SELECT *, (rank % ceil(n / 4.0))::BIGINT AS grp FROM ngrp WHERE rank < 16 AND n >= 2),
par AS (SELECT session, seq, grp, count(*) AS members, min(rank) AS first_rank, max(deadline) + 1000000 AS deadline FROM grouped GROUP BY session, seq, grp HAVING count(*) >= 2)"""
)


def accesses(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.concat(F.col("event_type"), F.lit("/"), (F.col("user_id") % 40).cast("string"))
    size = 1000 + F.pmod(F.col("user_id") % 40 * 7919 + F.length("event_type") * 104729, F.lit(9000))
    order = Window.partitionBy("trace").orderBy("ts", "event_id")
    return e.select(F.concat(F.lit("t"), (F.col("event_id") % 8).cast("string")).alias("trace"), k.alias("key"), size.cast("long").alias("bytes"), "ts", "event_id").withColumn("ord", F.row_number().over(order).cast("long")).select("trace", "ord", F.when(F.col("event_id") % 11 == 0, "peek").otherwise("get").alias("op"), "key", "bytes")


ACCESS_SQL = """acc AS (SELECT 't' || (event_id % 8) AS trace, row_number() OVER (PARTITION BY event_id % 8 ORDER BY ts, event_id) AS ord,
  event_type || '/' || (user_id % 40) AS key, (1000 + (user_id % 40 * 7919 + length(event_type) * 104729) % 9000)::BIGINT AS bytes FROM events)"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.lit(7).alias("z"), (F.col("doc_id") % 64).alias("x"), F.floor(F.col("doc_id") / 64).cast("long").alias("y"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"), "doc_id")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.select("session", F.col("n").alias("ord"), F.col("t0").alias("t_ns"), (F.floor("value").cast("long") % 64).alias("cola"), (F.col("event_type") != "error").alias("demand"), F.greatest(F.col("n") - F.col("event_id") % 5, F.lit(0)).alias("max_num"))


REPORTS_SQL = f"""{EVENTS_SQL}, reps AS (SELECT session, n AS ord, t0 AS t_ns, floor(value)::BIGINT % 64 AS cola, event_type <> 'error' AS demand, greatest(n - event_id % 5, 0) AS max_num FROM ev)"""
