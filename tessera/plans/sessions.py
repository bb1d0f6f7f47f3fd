"""Queries of sessions, receivers, ingest streams and clients, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import hashing as H
from tessera.functions import messages as M
from tessera.operators import control, pyramid, session, viewport
from tessera.plans import fixtures as X
from tessera.plans.registry import query
from tessera.sources import png, tile_store

COMMANDS = ["LIST", "OPEN", "VIEWPORT", "REPORT", "BLOOM", "RESUME", "NOPE", "SIM", "CANCEL", "OPEN", "HELLO"]
CATALOG = [("img0", "READY"), ("img1", "READY"), ("img2", "PROCESSING"), ("img3", "FAILED"), ("img4", "UNREADABLE")]
_NAMES = ", ".join(f"'{c}'" for c in COMMANDS)
LOG_SQL = f"""{X.EVENTS_SQL}, cat(img, status) AS (VALUES {", ".join(map(str, CATALOG))}),
log AS (SELECT session, n, CASE WHEN event_id % 97 = 5 THEN NULL WHEN n = 1 THEN 'HELLO' ELSE [{_NAMES}][event_id % 11 + 1] END AS cmd, CASE WHEN session % 7 = 0 THEN 1 ELSE 2 END AS version, event_id % 50 AS cache, 'img' || (event_id % 6) AS img FROM ev),
m AS (SELECT log.*, status FROM log LEFT JOIN cat USING (img))"""


def _log(spark, sf):
    i, n = F.col("event_id"), F.col("n")
    names = F.array(*map(F.lit, COMMANDS))
    cmd = F.when(i % 97 == 5, None).when(n == 1, "HELLO").otherwise(F.get(names, (i % 11).cast("int")))
    return X.events(spark, sf).select("session", n.alias("ord"), cmd.alias("cmd"), F.when(F.col("session") % 7 == 0, 1).otherwise(2).alias("version"), (i % 50).alias("cache"), F.concat(F.lit("img"), (i % 6).cast("string")).alias("img"))


@query(f"""WITH RECURSIVE {LOG_SQL},
r(session, n, state, code, closes, segment) AS (
  SELECT session, 0::BIGINT, 'CONNECTED', 0, NULL::INT, 0::BIGINT FROM (SELECT DISTINCT session FROM m)
  UNION ALL SELECT session, n, CASE WHEN closes IS NOT NULL THEN 'CLOSED' WHEN code = 0 AND cmd = 'HELLO' THEN 'READY' WHEN code = 0 AND cmd IN ('OPEN', 'RESUME') THEN 'IMAGE_OPEN' ELSE was END, code, closes, seg + CASE WHEN code = 0 AND cmd IN ('OPEN', 'RESUME') THEN 1 ELSE 0 END FROM (
    SELECT *, CASE WHEN cmd IS NULL THEN 1003 WHEN code = 426 THEN 1002 END::INT AS closes FROM (
      SELECT m.session, m.n, m.cmd, r.state AS was, r.segment AS seg, CASE WHEN cmd IS NULL THEN 0
        WHEN cmd = 'NOPE' THEN 400
        WHEN cmd = 'HELLO' THEN CASE WHEN r.state <> 'CONNECTED' THEN 412 WHEN version <> 2 THEN 426 WHEN cache NOT BETWEEN 1 AND 1000000 THEN 400 ELSE 0 END
        WHEN r.state = 'CONNECTED' OR (cmd IN ('VIEWPORT', 'BLOOM', 'CANCEL', 'REPORT') AND r.state <> 'IMAGE_OPEN') OR (cmd = 'RESUME' AND r.state <> 'READY') THEN 412
        WHEN cmd = 'SIM' THEN 403
        WHEN cmd IN ('OPEN', 'RESUME') THEN CASE status WHEN 'READY' THEN 0 WHEN 'PROCESSING' THEN 409 WHEN 'FAILED' THEN 409 WHEN 'UNREADABLE' THEN 500 ELSE 404 END
        ELSE 0 END AS code FROM r JOIN m ON m.session = r.session AND m.n = r.n + 1 WHERE r.state <> 'CLOSED')))
SELECT session, n AS ord, state, code::INT AS code, closes, segment FROM r WHERE n > 0""")
def session_outcomes(spark, sf):
    """State, error and close code after every message, and how many images were opened."""
    cat = spark.createDataFrame(CATALOG, "img string, status string")
    return session.outcomes(_log(spark, sf), F.broadcast(cat)).select("session", "ord", "state", "code", "closes", "segment")


SENDS_SQL = f"""{X.EVENTS_SQL}, k AS (SELECT session, n AS ord, CASE WHEN event_id % 41 = 0 THEN 'open' WHEN event_id % 10 = 0 THEN 'snapshot' ELSE 'send' END AS kind, event_id % 30 AS key, event_id FROM ev),
s AS (SELECT *, count(*) FILTER (WHERE kind = 'send') OVER (PARTITION BY session ORDER BY ord) AS num FROM k),
l AS (SELECT session, ord, kind, key, num, greatest(0, num - event_id % 4) AS max FROM s)"""


def _sends(spark, sf):
    i = F.col("event_id")
    k = X.events(spark, sf).withColumn("kind", F.when(i % 41 == 0, "open").when(i % 10 == 0, "snapshot").otherwise("send"))
    num = F.sum((F.col("kind") == "send").cast("long")).over(Window.partitionBy("session").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return k.select("session", F.col("n").alias("ord"), "kind", (i % 30).alias("key"), num.alias("num"), i).withColumn("max", F.greatest(F.lit(0), F.col("num") - i % 4))


@query(f"""WITH {SENDS_SQL}, live AS (SELECT b.session, b.ord, b.max, x.num FROM l b JOIN l x ON x.session = b.session AND x.ord < b.ord AND b.kind = 'snapshot' AND x.kind = 'send'
  WHERE NOT EXISTS (SELECT 1 FROM l y WHERE y.session = x.session AND y.ord > x.ord AND y.ord < b.ord AND (y.kind = 'open' OR (y.kind = 'send' AND y.key = x.key) OR (y.kind = 'snapshot' AND y.max >= x.num))))
SELECT b.session, b.ord, count(*) FILTER (WHERE live.num <= b.max) AS forgotten, count(*) FILTER (WHERE live.num > b.max) AS remain FROM l b LEFT JOIN live ON live.session = b.session AND live.ord = b.ord WHERE b.kind = 'snapshot' GROUP BY 1, 2""")
def snapshot_recents(spark, sf):
    """Sends that each snapshot of the client's cache covers and forgets, and those still remembered; OPEN clears all."""
    return session.snapshots(_sends(spark, sf))


@query("""WITH c AS (SELECT DISTINCT user_id AS session, event_id % 90 AS x FROM events WHERE event_id % 3 = 0), p AS (SELECT DISTINCT user_id AS session, event_id % 90 AS x FROM events WHERE event_id % 4 = 0),
u AS (SELECT * FROM c UNION SELECT * FROM p), s AS (SELECT DISTINCT user_id AS session, event_id % 90 AS x FROM events WHERE event_id % 5 = 0), v AS (SELECT DISTINCT user_id AS session, event_id % 90 AS x FROM events)
SELECT v.session, v.x, u.x IS NOT NULL AS client, s.x IS NOT NULL AS recent, u.x IS NOT NULL OR s.x IS NOT NULL AS held FROM v LEFT JOIN u ON u.session = v.session AND u.x = v.x LEFT JOIN s ON s.session = v.session AND s.x = v.x""")
def holdings(spark, sf):
    """What a session holds: the client's cache and what it decodes, as a RESUME seeds it, or what was sent since."""
    e = X.table(spark, sf, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 90).alias("x"), "event_id")
    at = lambda k: e.where(F.col("event_id") % k == 0).select("session", "x")
    client = at(3).union(at(4)).distinct().withColumn("client", F.lit(True))
    recent = at(5).distinct().withColumn("recent", F.lit(True))
    out = e.select("session", "x").distinct().join(client, ["session", "x"], "left").join(recent, ["session", "x"], "left").na.fill(False, ["client", "recent"])
    return out.withColumn("held", F.col("client") | F.col("recent"))


FIRST_SEQ = 50
FRAMES_SQL = """fr AS (SELECT doc_id % 16 AS session, doc_id // 16 + 1 AS num, doc_id, strlen(coalesce(text, ''))::BIGINT AS n FROM documents WHERE doc_id % 19 <> 0),
vd AS (SELECT *, CASE WHEN doc_id % 23 = 0 OR (doc_id % 11 = 0 AND n = 0) THEN 'short' WHEN doc_id % 13 = 0 THEN 'version' WHEN doc_id % 17 = 0 THEN 'type' WHEN doc_id % 11 = 0 THEN 'length' WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 5 = 0 AND n > 0 THEN 'crc' ELSE 'ok' END AS verdict,
  CASE WHEN doc_id % 23 = 0 THEN 20 WHEN doc_id % 11 = 0 THEN 27 + n ELSE 28 + n END AS bytes FROM fr)"""


def _frames(spark, sf):
    """TILE frames of the documents as a receiver gets them: some never, some cut, stale or broken."""
    i, f = F.col("doc_id"), F.col("frame")
    t = X.tiles(spark, sf).where(i % 19 != 0).withColumn("num", F.floor(i / 16) + 1)
    t = t.withColumn("frame", M.tile_frame(F.when(i % 7 == 0, 3).otherwise(i + 100), "num", "z", "x", "y", F.lit(2), "payload"))
    sub = lambda a, n=None: F.substr(f, F.lit(a), F.lit(n)) if n else F.substr(f, F.lit(a))
    t = t.withColumn("frame", F.when((i % 5 == 0) & (F.length("payload") > 0), F.concat(sub(1, 24), F.unhex(F.lit("00000000")), sub(29))).otherwise(f))
    t = t.withColumn("frame", F.when(i % 17 == 0, F.concat(sub(1, 1), F.unhex(F.lit("03")), sub(3))).otherwise(f))
    t = t.withColumn("frame", F.when(i % 13 == 0, F.concat(F.unhex(F.lit("01")), sub(2))).otherwise(f))
    t = t.withColumn("frame", F.when(i % 23 == 0, sub(1, 20)).when(i % 11 == 0, F.substr(f, F.lit(1), F.length(f) - 1)).otherwise(f))
    return t.select((i % 16).alias("session"), i.alias("ord"), "frame")


@query(f"WITH {FRAMES_SQL} SELECT session, doc_id AS ord, verdict FROM vd")
def frame_verdicts(spark, sf):
    return session.verdicts(_frames(spark, sf), FIRST_SEQ).select("session", "ord", "verdict")


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT *, CASE WHEN verdict IN ('short', 'version') THEN 0 ELSE greatest(0, num - coalesce(max(CASE WHEN verdict NOT IN ('short', 'version') THEN num END) OVER (PARTITION BY session ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1) END AS gap FROM vd)
SELECT session, count(*) AS frames, sum(bytes)::BIGINT AS bytes, count(*) FILTER (WHERE verdict = 'ok') AS tiles, count(*) FILTER (WHERE verdict = 'crc') AS bad_crc, count(*) FILTER (WHERE verdict NOT IN ('ok', 'crc')) AS dropped, sum(gap)::BIGINT AS lost, 100.0::DOUBLE * sum(bytes) / (5775 * 5775 * 3) AS pct_of_original FROM l GROUP BY 1""")
def transfer_summary(spark, sf):
    """A receiver's counters, from the bytes of its frames."""
    return session.counters(_frames(spark, sf), FIRST_SEQ).withColumn("pct_of_original", F.lit(100.0) * F.col("bytes") / (5775 * 5775 * 3))


GROUPS_SQL = """mem AS (SELECT doc_id // 4 AS grp, doc_id, coalesce(text, '') AS t, NOT (doc_id % 7 IN (0, 3)) AS here FROM documents),
g AS (SELECT grp, count(*) AS k, count(*) FILTER (WHERE NOT here) AS missing, any_value(CASE WHEN NOT here THEN t END) AS lost, sum(CASE WHEN here THEN strlen(t) ELSE 0 END) AS there FROM mem GROUP BY 1 HAVING count(*) >= 2)"""


@query(f"""WITH {GROUPS_SQL}, o AS (SELECT *, CASE WHEN grp % 9 = 0 OR grp % 8 = 3 OR grp % 6 = 5 THEN 'dropped' WHEN grp % 10 = 4 THEN 'bad_crc' WHEN missing = 0 THEN 'unneeded' WHEN missing > 1 THEN 'irrecoverable' WHEN grp % 11 = 2 AND lost <> '' AND there > 0 THEN 'crc' ELSE 'recovered' END AS outcome FROM g)
SELECT grp, outcome, CASE WHEN outcome = 'recovered' THEN md5(hex(encode(lost))) END AS payload_md5 FROM o""")
def fec_receive(spark, sf):
    """PARITY frames of the documents by fours at a receiver that lacks some tiles and has some broken ones."""
    i, grp = F.col("doc_id"), F.col("grp")
    t = X.tiles(spark, sf).withColumn("grp", F.floor(i / 4).cast("long"))
    parity = viewport.parity_bytes(t.select("grp", "payload"), "grp")
    one = F.struct("z", "x", "y", F.lit(2).alias("fmt"), F.length("payload").alias("len"), F.crc32("payload").alias("crc"))
    g = t.groupBy("grp").agg(F.array_sort(F.collect_list(one)).alias("members")).where(F.size("members") >= 2).join(parity, "grp")
    f, seq = F.col("frame"), F.when(grp % 6 == 5, 1).otherwise(grp + 100)
    g = g.withColumn("frame", M.parity_frame(seq, grp, "members", "parity")).repartition("grp")  # frames are made once
    g = g.withColumn("frame", F.when(grp % 9 == 0, F.concat(F.substr(f, F.lit(1), F.lit(10)), F.unhex(F.lit("05")), F.substr(f, F.lit(12)))).when(grp % 8 == 3, F.substr(f, F.lit(1), F.length(f) - 1)).otherwise(f))
    at = (15 + 18 * F.size("members")).cast("int")  # where the parity's checksum stands
    bad = F.bitwise_not(F.crc32("parity")).bitwiseAND(F.lit(H.MASK))
    g = g.withColumn("frame", F.when(grp % 10 == 4, F.concat(F.substr(f, F.lit(1), at), M.bytes_of(bad, 4), F.substr(f, at + 5))).otherwise(f))
    here = t.where(~(i % 7).isin(0, 3)).select("z", "x", "y", F.when(grp % 11 == 2, F.unhex(F.lit(""))).otherwise(F.col("payload")).alias("payload"))
    out = session.recover(g.select("grp", "frame").repartition("grp"), here, FIRST_SEQ)
    return out.select("grp", "outcome", F.when(F.col("outcome") == "recovered", F.md5(F.hex("payload"))).alias("payload_md5"))


DRAWS_SQL = f"""d(k, s) AS (SELECT 1::BIGINT, {((42 ^ 0x5DEECE66D) * 0x5DEECE66D + 11) % (1 << 48)}::BIGINT UNION ALL SELECT k + 1, ((s::HUGEINT * 25214903917 + 11) % 281474976710656)::BIGINT FROM d WHERE k < (SELECT max(n) FROM ev))"""


@query(f"""WITH RECURSIVE {X.EVENTS_SQL}, {DRAWS_SQL}, b AS (SELECT session, n, event_id, t0, 500 + floor(value * 100)::BIGINT AS bytes, event_id % 4 <> 0 AS bin, count(*) FILTER (WHERE event_id % 4 <> 0) OVER (PARTITION BY session ORDER BY n) AS k FROM ev),
s AS (SELECT b.*, row_number() OVER (PARTITION BY session ORDER BY n) AS j FROM b JOIN d ON d.k = greatest(b.k, 1) WHERE NOT (bin AND (s >> 17) % 100 < 20)),
r(session, j, free_ns) AS (SELECT session, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT session FROM s) UNION ALL SELECT s.session, s.j, greatest(s.t0, r.free_ns) + s.bytes * 1000000 // 3 FROM r JOIN s ON s.session = r.session AND s.j = r.j + 1)
SELECT s.session, n AS ord, free_ns + 40000000 AS out_ns FROM r JOIN s USING (session, j)""")
def link_delivery(spark, sf):
    """A link that loses a fifth of the binaries and queues the rest and all texts in order; a lost one takes no time."""
    m = X.events(spark, sf).select("session", F.col("n").alias("ord"), (F.col("event_id") % 4 != 0).alias("is_binary"), F.col("t0").alias("now_ns"), (500 + F.floor(F.col("value") * 100)).alias("bytes"))
    kept = m.join(control.random_loss(m, 20).where("not lost").select("session", "ord"), ["session", "ord"])
    return control.link_departures(kept, 3, 40).select("session", "ord", "out_ns")


@query(f"WITH {X.EVENTS_SQL} SELECT session, n AS ord, t0 AS free_ns, t0 + 80000000 AS out_ns FROM ev WHERE session >= 0")
def link_unlimited(spark, sf):
    m = X.events(spark, sf).select("session", F.col("n").alias("ord"), F.col("t0").alias("now_ns"), F.lit(1000).cast("long").alias("bytes"))
    return control.link_departures(m, 0, 80).select("session", "ord", "free_ns", "out_ns")


@query(f"""WITH {X.EVENTS_SQL}, c AS (SELECT session, n, event_id % 51 AS loss, event_id % 2000 AS latency FROM ev WHERE event_id % 9 = 0), m AS (SELECT session, n FROM ev WHERE event_id % 9 <> 0)
SELECT m.session, m.n AS ord, c.loss, c.latency FROM m ASOF LEFT JOIN c ON c.session = m.session AND c.n < m.n""")
def sim_settings(spark, sf):
    """The simulated link's settings that hold for each message: those of the last SIM before it."""
    e, i = X.events(spark, sf).withColumnRenamed("n", "ord"), F.col("event_id")
    c = e.where(i % 9 == 0).select("session", "ord", (i % 51).alias("loss"), (i % 2000).alias("latency"))
    return session.as_of(e.where(i % 9 != 0).select("session", "ord"), c, ["loss", "latency"])


@query(f"""WITH {X.EVENTS_SQL}, v AS (SELECT *, 1 + event_id // 700 AS version FROM ev), o AS (SELECT session, n, version FROM v WHERE event_id % 8 = 1), q AS (SELECT session, n, version, event_id FROM v WHERE event_id % 8 <> 1)
SELECT q.session, q.n AS ord, o.version AS opened, q.version AS current, CASE WHEN o.version IS NULL THEN 412 WHEN q.event_id % 31 = 0 THEN 409 ELSE 0 END AS code, o.version IS NOT NULL AND q.event_id % 31 <> 0 AND o.version <> q.version AS reopened, 'img#' || q.version || '/3/' || (q.event_id % 8) || '/2' AS cache_key FROM q ASOF LEFT JOIN o ON o.session = q.session AND o.n < q.n""")
def image_versions(spark, sf):
    """Views against the image as it is now: 409 while it is made anew, opened again where its version has changed."""
    i = F.col("event_id")
    e = X.events(spark, sf).withColumnRenamed("n", "ord").withColumn("version", F.floor(i / 700) + 1)
    q = session.as_of(e.where(i % 8 != 1).select("session", "ord", F.col("version").alias("current"), "event_id"), e.where(i % 8 == 1).select("session", "ord", F.col("version").alias("opened")), ["opened"])
    code = F.when(F.col("opened").isNull(), 412).when(i % 31 == 0, 409).otherwise(0)
    return q.select("session", "ord", "opened", "current", code.alias("code"), (F.col("opened").isNotNull() & (i % 31 != 0) & (F.col("opened") != F.col("current"))).alias("reopened"), M.cache_key(F.lit("img"), "current", F.lit(3), i % 8, F.lit(2)).alias("cache_key"))


@query("""WITH e AS (SELECT user_id % 60 AS id, ts, event_id, CASE event_type WHEN 'error' THEN 'exit' WHEN 'click' THEN 'start' ELSE 'line' END AS kind, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS exit_code, event_id % 5 <> 0 AS marker, 'Franja ' || (event_id % 30) || '/29' AS line FROM events),
s AS (SELECT *, CASE WHEN kind = 'exit' THEN CASE WHEN exit_code = 0 AND marker THEN 'READY' ELSE 'FAILED' END ELSE 'PROCESSING' END AS state, CASE kind WHEN 'start' THEN 0 WHEN 'line' THEN least(99, 100 * (event_id % 30) // 29) WHEN 'exit' THEN 100 END::INT AS progress FROM e)
SELECT id, arg_max(state, (ts, event_id)) AS state, CASE WHEN arg_max(state, (ts, event_id)) = 'FAILED' THEN NULL ELSE arg_max(progress, (ts, event_id)) END AS progress, count(*) FILTER (WHERE state = 'READY') AS versions FROM s GROUP BY 1""")
def ingest_states(spark, sf):
    """State and progress of every image after its last event; READY needs exit 0 and the marker, and makes a version."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "exit").when(F.col("event_type") == "click", "start").otherwise("line")
    e = X.table(spark, sf, "events").select((F.col("user_id") % 60).alias("id"), "ts", i, kind.alias("kind"), F.concat(F.lit("Franja "), (i % 30).cast("string"), F.lit("/29")).alias("line"))
    good = (i % 4 != 0) & (i % 5 != 0)
    state = F.when(F.col("kind") != "exit", "PROCESSING").when(good, "READY").otherwise("FAILED")
    progress = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "line", M.progress_of("line")).otherwise(100)
    g = e.select("id", F.struct("ts", "event_id").alias("at"), state.alias("state"), progress.cast("int").alias("progress")).groupBy("id")
    out = g.agg(F.max_by("state", "at").alias("state"), F.max_by("progress", "at").alias("progress"), F.count_if(F.col("state") == "READY").alias("versions"))
    return out.withColumn("progress", F.when(F.col("state") != "FAILED", F.col("progress")))


@query("""WITH RECURSIVE f AS (SELECT event_type || '/' || (user_id % 30) AS path, row_number() OVER (PARTITION BY event_type, user_id % 30 ORDER BY ts, event_id) AS n, (event_id % 3) || '/' || (event_id % 2) AS fp, event_id % 7 <> 0 AS ok FROM events),
r(path, n, last, taken) AS (SELECT path, 0::BIGINT, NULL::VARCHAR, false FROM (SELECT DISTINCT path FROM f)
  UNION ALL SELECT f.path, f.n, CASE WHEN f.fp IS NOT DISTINCT FROM r.last THEN r.last WHEN ok THEN fp END, f.fp IS DISTINCT FROM r.last FROM r JOIN f ON f.path = r.path AND f.n = r.n + 1)
SELECT path, n AS ord, taken FROM r WHERE n > 0""")
def ingest_retry(spark, sf):
    """Arrivals that are ingested: not those with the fingerprint of the last ingest, but again after a failure."""
    i = F.col("event_id")
    path = F.concat(F.col("event_type"), F.lit("/"), (F.col("user_id") % 30).cast("string"))
    f = X.table(spark, sf, "events").select(path.alias("path"), "ts", i, M.fingerprint(i % 3, i % 2).alias("fingerprint"), (i % 7 != 0).alias("ok"))
    return session.attempts(f.withColumn("ord", F.row_number().over(Window.partitionBy("path").orderBy("ts", "event_id"))))


@query("""WITH RECURSIVE j AS (SELECT event_type AS worker, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, epoch_us(ts) * 1000 AS t, 1000000000 * (60 + event_id % 2000) AS took FROM events),
r(worker, n, start_ns, end_ns) AS (SELECT worker, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT worker FROM j) UNION ALL SELECT j.worker, j.n, greatest(j.t, r.end_ns), greatest(j.t, r.end_ns) + j.took FROM r JOIN j ON j.worker = r.worker AND j.n = r.n + 1)
SELECT worker, n AS ord, start_ns, end_ns FROM r WHERE n > 0""")
def ingest_worker(spark, sf):
    """One job at a time in order of arrival: when each starts and ends."""
    e = X.table(spark, sf, "events").select(F.col("event_type").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("now_ns"), "event_id", (1000 * (60 + F.col("event_id") % 2000)).alias("bytes"))
    e = e.withColumn("ord", F.row_number().over(Window.partitionBy("session").orderBy("now_ns", "event_id")).cast("long"))
    out = control.link_departures(e, 1)
    return out.select(F.col("session").alias("worker"), "ord", (F.col("free_ns") - F.col("bytes") * 1_000_000).alias("start_ns"), F.col("free_ns").alias("end_ns"))


@query(r"""WITH n AS (SELECT page_id, regexp_extract(url, '[^/]*$') || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.tmp' ELSE '.tif' END AS name FROM pages),
c AS (SELECT page_id, name, substr(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '[^A-Za-z0-9_-]', '_', 'g'), 1, 64) AS id FROM n WHERE lower(name) NOT LIKE '%.tmp' AND NOT starts_with(name, '.')), have AS (SELECT DISTINCT id FROM c WHERE page_id % 3 = 0)
SELECT c.page_id, c.id, CASE WHEN have.id IS NULL THEN 'PROCESSING' ELSE 'seen' END AS status FROM c LEFT JOIN have USING (id)""")
def ingest_backlog(spark, sf):
    """Files found at the start: those without a pyramid are queued, the others only remembered."""
    m = F.col("page_id") % 4
    n = X.table(spark, sf, "pages").select("page_id", F.concat(F.regexp_extract("url", "[^/]*$", 0), F.when(m == 0, ".png").when(m == 1, ".tmp").otherwise(".tif")).alias("name"))
    c = n.where(M.is_candidate("name")).select("page_id", M.image_id("name").alias("id"))
    have = c.where("page_id % 3 = 0").select("id").distinct()
    queued = c.join(have, "id", "left_anti").withColumn("status", F.lit("PROCESSING"))
    return queued.unionByName(c.join(have, "id", "left_semi").withColumn("status", F.lit("seen")))


@query(f"WITH {X.EVENTS_SQL}, l AS (SELECT session, event_id % 200 AS key, max(n) AS num FROM ev GROUP BY 1, 2) SELECT * FROM (SELECT session, key, num, row_number() OVER (PARTITION BY session ORDER BY num DESC) AS place FROM l) WHERE place <= 32")
def last_raw_tiles(spark, sf):
    return session.last_tiles(X.events(spark, sf).select("session", F.col("n").alias("num"), (F.col("event_id") % 200).alias("key"))).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {X.EVENTS_SQL}, v AS (SELECT session, n, t0 // 1000000 AS t_ms, event_id % 3 AS sig FROM ev), c AS (SELECT *, lag(sig) OVER (PARTITION BY session ORDER BY t_ms, n) AS was FROM v)
SELECT session, n AS ord FROM (SELECT *, row_number() OVER (PARTITION BY session, t_ms // 40000000 ORDER BY t_ms DESC, n DESC) AS place FROM c WHERE sig IS DISTINCT FROM was) WHERE place = 1""")
def view_throttle(spark, sf):
    """Declared views: only changed ones, and the last of each step."""
    v = X.events(spark, sf).select("session", F.col("n").alias("ord"), F.floor(F.col("t0") / 1_000_000).alias("t_ms"), (F.col("event_id") % 3).alias("signature"))
    return session.throttled(v, 40_000_000).select("session", "ord")


@query("""WITH e AS (SELECT user_id AS session, epoch_us(ts) // 1000000 AS t, event_type = 'error' AS changed FROM events), w AS (SELECT session, t // 3600 AS tick, count(*) AS frames, bool_or(changed) AS changed FROM e GROUP BY 1, 2)
SELECT session, tick, frames, changed AS snapshot FROM w""")
def report_ticks(spark, sf):
    """One report a session and step, with a snapshot of the cache where it has changed in the step."""
    e = X.table(spark, sf, "events")
    g = e.groupBy(F.col("user_id").alias("session"), F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("frames"), F.bool_or(F.col("event_type") == "error").alias("snapshot"))
    return g.select("session", F.floor(F.unix_seconds("w.start") / 3600).alias("tick"), "frames", "snapshot")


@query(f"""WITH {X.EVENTS_SQL}, s AS (SELECT user_id % 40 AS id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n, ts, event_id, event_id % 3 <> 0 AS ready FROM events), l AS (SELECT *, lag(ready) OVER (PARTITION BY id ORDER BY n) AS was FROM s)
SELECT id, n AS ord, ready, coalesce(ready AND NOT was, false) AS reopen FROM l""")
def image_reopened(spark, sf):
    """Listings in which an image becomes READY after it was not: the client opens it again."""
    s = X.table(spark, sf, "events").select((F.col("user_id") % 40).alias("id"), "ts", "event_id", (F.col("event_id") % 3 != 0).alias("ready"))
    w = Window.partitionBy("id").orderBy("ts", "event_id")
    return s.select("id", F.row_number().over(w).cast("long").alias("ord"), "ready", F.coalesce(F.col("ready") & ~F.lag("ready").over(w), F.lit(False)).alias("reopen"))


@query("""WITH s AS (SELECT user_id AS session, event_type, 'img' || (event_id % 50) AS id, event_id % 4 <> 0 AS ready FROM events)
SELECT session, event_type, min(CASE WHEN ready THEN id END) AS opens FROM s GROUP BY 1, 2""")
def image_selection(spark, sf):
    """The image a client without one opens: the first READY of the list."""
    s = X.table(spark, sf, "events").groupBy(F.col("user_id").alias("session"), "event_type")
    return s.agg(F.min(F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("img"), (F.col("event_id") % 50).cast("string")))).alias("opens"))


@query(f"WITH {X.EVENTS_SQL}, d AS (SELECT session, n, t0, floor(value * 1e8)::BIGINT AS svc FROM ev), s AS (SELECT *, sum(svc) OVER w AS total FROM d WINDOW w AS (PARTITION BY session ORDER BY n)) SELECT session, n AS ord, (total + max(t0 - (total - svc)) OVER (PARTITION BY session ORDER BY n))::BIGINT AS decoded_ns FROM s")
def slow_client(spark, sf):
    """A client that decodes one tile after the other."""
    d = X.events(spark, sf).select("session", F.col("n").alias("ord"), F.col("t0").alias("now_ns"), F.floor(F.col("value") * F.lit(1e8)).cast("long").alias("svc"))
    w = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    s = d.withColumn("total", F.sum("svc").over(w))
    return s.select("session", "ord", (F.col("total") + F.max(F.col("now_ns") - (F.col("total") - F.col("svc"))).over(w)).alias("decoded_ns"))


@query(f"""WITH {X.EVENTS_SQL}, v AS (SELECT session, n, event_id % 4 = 0 AS decoding, event_id % 3 AS missing, event_id % 5 + 1 AS tries FROM ev)
SELECT session, n AS ord, NOT decoding AND missing > 0 AND tries <= 3 AS again, CASE WHEN NOT decoding AND missing > 0 AND tries = 3 THEN (4294967294 + n) & 4294967295 ELSE (4294967293 + n) & 4294967295 END AS seed FROM v""")
def view_again(spark, sf):
    """Views declared again after DONE: nothing decoding, tiles missing, three tries at most; the third takes a new seed."""
    i, tries = F.col("event_id"), F.col("event_id") % 5 + 1
    again = (i % 4 != 0) & (i % 3 > 0) & (tries <= 3)
    seed = (F.lit(4294967293) + F.col("n")).bitwiseAND(F.lit(H.MASK))
    return X.events(spark, sf).select("session", F.col("n").alias("ord"), again.alias("again"), F.when(again & (tries == 3), H.rotate_seed(seed)).otherwise(seed).alias("seed"))


@query("""WITH r AS (SELECT event_id, event_id % 7 AS z, event_id * 7 % 64 AS x, event_id * 3 % 20 AS y FROM events), t AS (SELECT doc_id % 64 AS x, doc_id // 64 AS y, strlen(coalesce(text, '')) AS n FROM documents WHERE doc_id % 5 <> 0)
SELECT event_id, r.x, r.y, t.n IS NULL AS failed, CASE WHEN t.n IS NULL THEN 500 END::INT AS code, CASE WHEN t.n IS NOT NULL THEN count(t.n) OVER (ORDER BY event_id) END AS num FROM r LEFT JOIN t ON r.x = t.x AND r.y = t.y WHERE event_id < 1000000""".replace("ORDER BY event_id)", "PARTITION BY event_id % 16 ORDER BY event_id)"))
def tile_failures(spark, sf):
    """Requested tiles that cannot be read: error 500, no number, not among the sent."""
    i = F.col("event_id")
    r = X.table(spark, sf, "events").select(i, (i * 7 % 64).alias("x"), (i * 3 % 20).alias("y"))
    t = X.tiles(spark, sf).where("doc_id % 5 <> 0").select("x", "y", F.length("payload").alias("n"))
    got = r.join(t, ["x", "y"], "left")
    num = F.count("n").over(Window.partitionBy(i % 16).orderBy("event_id"))
    return got.select("event_id", "x", "y", F.col("n").isNull().alias("failed"), F.when(F.col("n").isNull(), 500).alias("code"), F.when(F.col("n").isNotNull(), num).alias("num"))


@query("""WITH p AS (SELECT doc_id AS a, unnest(range(16)) AS i, length(coalesce(text, '')) AS v FROM documents) SELECT a % 6 AS z, count(*) FILTER (WHERE (v + i) % 256 <> (v + i + CASE WHEN (a + i) % 10 = 0 THEN 1 ELSE 0 END) % 256 OR (a + i) % 97 = 0) AS differing FROM p GROUP BY 1""")
def pixel_differences(spark, sf):
    """Pixels of two rasters that differ in a colour channel or are in one of them alone, by level."""
    d = X.table(spark, sf, "documents").select((F.col("doc_id") % 6).alias("z"), F.col("doc_id").alias("y"), F.length(F.coalesce("text", F.lit(""))).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
    s = F.col("y") + F.col("x")
    a = d.select("z", "x", "y", ((F.col("v") + F.col("x")) % 256).alias("b"), F.lit(0).alias("g"))
    b = d.where(s % 97 != 0).select("z", "x", "y", ((F.col("v") + F.col("x") + F.when(s % 10 == 0, 1).otherwise(0)) % 256).alias("b"), F.lit(0).alias("g"))
    return pyramid.differing(a, b, ["b", "g"])


@query(f"WITH {X.REPORTS_SQL} SELECT session, max(cola)::DOUBLE AS q_max, max(CASE WHEN abs(cola - 8.0::DOUBLE) > 2 THEN ord END) AS settle_t, arg_max(cola, ord)::DOUBLE AS q_final FROM reps GROUP BY 1")
def settling_times(spark, sf):
    return control.settling(X.reports(spark, sf).select("session", F.col("ord").alias("t"), F.col("cola").cast("double").alias("q")))


@query("""WITH n AS (SELECT unnest(range(2, 17)) AS n), r AS (SELECT n, unnest(range(n)) AS rank FROM n), g AS (SELECT n, rank, rank % ceil(n / 4.0)::BIGINT AS grp FROM r),
w AS (SELECT a.n, a.rank AS first, b.grp, count(*) AS hit FROM g a JOIN g b ON a.n = b.n AND b.rank BETWEEN a.rank AND a.rank + ceil(a.n / 4.0)::BIGINT - 1 GROUP BY 1, 2, 3)
SELECT n, max(hit) AS worst FROM w GROUP BY 1""")
def burst_tolerance(spark, sf):
    """The most members of one parity group that a burst as long as the number of groups takes, for every view size."""
    n = spark.range(2, 17).select(F.col("id").alias("n"))
    r = n.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("groups", F.ceil(F.col("n") / 4)).withColumn("grp", F.col("rank") % F.col("groups"))
    burst = r.select("n", "grp", F.explode(F.sequence(F.col("rank") - F.col("groups") + 1, "rank")).alias("first")).where("first >= 0")
    return burst.groupBy("n", "first", "grp").agg(F.count("*").alias("hit")).groupBy("n").agg(F.max("hit").alias("worst"))


@query("""WITH a AS (SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id % 40 AS key FROM events), l AS (SELECT trace, key, max(ord) AS last FROM a GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY last DESC) AS place FROM l) SELECT trace, count(*) AS kept, sum((16 + key) * 256 * 4)::BIGINT AS bytes, bool_or(place > 20) AS evicted FROM k GROUP BY 1""".replace("SELECT trace, count(*) AS kept, sum((16 + key) * 256 * 4)::BIGINT AS bytes", "SELECT trace, count(*) FILTER (WHERE place <= 20) AS kept, sum(CASE WHEN place <= 20 THEN (16 + key) * 256 * 4 ELSE 0 END)::BIGINT AS bytes"))
def client_cache(spark, sf):
    """A client's cache of 20 tiles: what it holds at the end, its bytes, and whether it evicted any."""
    a = X.events(spark, sf).select("session", F.col("n").alias("num"), (F.col("event_id") % 40).alias("key"))
    held = session.last_tiles(a, 20).groupBy(F.col("session").alias("trace")).agg(F.count("*").alias("kept"), F.sum((16 + F.col("key")) * 256 * 4).alias("bytes"))
    every = a.groupBy(F.col("session").alias("trace")).agg(F.countDistinct("key").alias("keys"))
    return held.join(every, "trace").select("trace", "kept", "bytes", (F.col("keys") > 20).alias("evicted"))


@query("""SELECT event_id, 'OPEN|IMG:a/b ' || (event_id % 9) || '|SEM:' || event_id AS message, (event_id % 9) || ',' || event_id || ',' || (event_id % 4) AS tile_key, event_id || '/' || (event_id * 3) AS fingerprint,
  event_id % 3 <> 1 AS upgrade, event_id % 2 = 0 AS valid_utf8, event_id % 5 = 0 AS bits_ok, (event_id % 8) * 32.0::DOUBLE AS rect_x, (event_id % 3 % 8) * 32.0::DOUBLE AS rect_y, 32.0::DOUBLE AS rect_side, 7 * (1 + 5 * 3) AS png_bytes,
  CASE event_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'bmp' END AS fmt, (event_id % 500 + 1)::INT AS meta_width, least(10000, greatest(0, floor(value + 0.5)))::BIGINT AS clamped FROM events""")
def more_scalars(spark, sf):
    i = F.col("event_id")
    head = F.when(i % 3 == 0, "Keep-Alive, UPGRADE").when(i % 3 == 1, "keep-alive,upgrades").otherwise("upgrade ")
    raw = F.when(i % 2 == 0, F.unhex(F.lit("C3A9"))).otherwise(F.unhex(F.lit("C328")))
    bits = F.base64(F.unhex(F.repeat(F.lit("0A"), F.when(i % 5 == 0, 512).otherwise(511))))
    magic = F.unhex(F.when(i % 4 == 0, "89504E470D0A1A0A00").when(i % 4 == 1, "FFD8FFE000").when(i % 4 == 2, "424D0000").otherwise("0000"))
    meta = tile_store.parse_meta(F.concat(F.lit('{"ancho":'), (i % 500 + 1).cast("string"), F.lit(',"alto":3,"tile":256,"formato":"PNG","niveles":1}')))
    left, top, side = G.ancestor_rect(i, i % 3, 3)
    return X.table(spark, sf, "events").select(
        i, M.serialise("OPEN", {"IMG": F.concat(F.lit("a|b "), (i % 9).cast("string")), "SEM": i}).alias("message"), M.tile_text(i % 9, i, i % 4).alias("tile_key"), M.fingerprint(i, i * 3).alias("fingerprint"),
        M.has_token(head, "upgrade").alias("upgrade"), F.is_valid_utf8(raw.cast("string")).alias("valid_utf8"), M.filter_bits(bits).isNotNull().alias("bits_ok"), left.alias("rect_x"), top.alias("rect_y"), side.alias("rect_side"),
        F.lit(png.expected_bytes(5, 7, 3)).cast("int").alias("png_bytes"), tile_store.format_of(magic).alias("fmt"), meta["ancho"].alias("meta_width"), M.clamp_report("value", 10_000).alias("clamped"),
    )


@query("""WITH o AS (SELECT event_type, 'img' || (user_id % 40) AS id, max(event_id % 101)::INT AS progress FROM events GROUP BY 1, 2) SELECT event_type, id, CASE WHEN progress >= 100 THEN 'READY' ELSE 'PROCESSING' END AS state, progress FROM o""")
def list_decode(spark, sf):
    """LIST written and read back."""
    o = X.table(spark, sf, "events").groupBy("event_type", F.concat(F.lit("img"), (F.col("user_id") % 40).cast("string")).alias("id")).agg(F.max(F.col("event_id") % 101).alias("p"))
    rows = o.groupBy("event_type").agg(F.array_join(F.collect_list(M.encode_list("id", F.when(F.col("p") >= 100, "READY").otherwise("PROCESSING"), "p")), ";").alias("text"))
    return rows.select("event_type", F.explode(M.decode_list("text")).alias("e")).select("event_type", "e.id", "e.state", "e.progress")


@query("""WITH b AS (SELECT DISTINCT user_id AS session, event_id * 37 % 4096 AS bit FROM events), y AS (SELECT session, bit // 8 AS pos, sum(1 << (bit % 8)::INT)::BIGINT AS v FROM b GROUP BY 1, 2),
g AS (SELECT s.session, t.pos, coalesce(v, 0) AS v FROM (SELECT DISTINCT session FROM b) s CROSS JOIN range(512) t(pos) LEFT JOIN y ON y.session = s.session AND y.pos = t.pos)
SELECT session, md5(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY pos)) AS bitmap_md5 FROM g GROUP BY 1""")
def bloom_bitmap(spark, sf):
    """Filters as 512-byte bitmaps, least significant bit first."""
    b = X.table(spark, sf, "events").select(F.col("user_id").alias("session"), (F.col("event_id") * 37 % 4096).alias("bit"))
    return viewport.bitmap(b, ["session"]).select("session", F.md5(F.hex("bitmap")).alias("bitmap_md5"))


@query("""WITH t AS (SELECT doc_id % 3 AS img, 7 AS z, doc_id % 64 AS x, doc_id // 64 AS y, strlen(coalesce(text, ''))::BIGINT AS length FROM documents)
SELECT img, z, x, y, length, coalesce(sum(length) OVER (PARTITION BY img, z ORDER BY y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", y * 64 + x AS slot FROM t""")
def image_tile_index(spark, sf):
    """Offsets of several images: each level of each begins at 0."""
    t = X.tiles(spark, sf).select((F.col("doc_id") % 3).alias("img"), "z", "x", "y", F.length("payload").cast("long").alias("length"))
    return pyramid.index(t, 64)


@query("""WITH t AS (SELECT doc_id % 3 AS img, strlen(coalesce(text, ''))::BIGINT AS n FROM documents) SELECT img, count(*) AS tiles, sum(n)::BIGINT AS bytes, sum(n) / 1024.0::DOUBLE / count(*) AS mean_kb, max(n) AS largest FROM t GROUP BY 1""")
def store_totals(spark, sf):
    t = X.tiles(spark, sf).groupBy((F.col("doc_id") % 3).alias("img")).agg(F.count("*").alias("tiles"), F.sum(F.length("payload")).alias("bytes"), F.max(F.length("payload")).cast("long").alias("largest"))
    return t.withColumn("mean_kb", F.col("bytes") / F.lit(1024.0) / F.col("tiles"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, 4 + value AS rate, event_id % 6 AS quiet FROM events),
r(session, n, sent_ns, slot) AS (SELECT session, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT session FROM e)
  UNION ALL SELECT e.session, e.n, r.slot, r.slot + floor(1e9::DOUBLE / CASE WHEN quiet * 100 > 300 THEN 4.0::DOUBLE ELSE e.rate END)::BIGINT FROM r JOIN e ON e.session = r.session AND e.n = r.n + 1)
SELECT session, n AS ord, sent_ns FROM r WHERE n > 0""")
def paced_sends(spark, sf):
    """Turns of a queue that never empties: each waits for the rate at the last send, the least one after 300 ms without a report."""
    e = X.events(spark, sf).select("session", F.col("n").alias("ord"), (4 + F.col("value")).alias("rate"), (F.col("event_id") % 6 * 100).alias("quiet_ms"))
    return control.turns(e).select("session", "ord", "sent_ns")
