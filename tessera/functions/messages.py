"""Text messages, names and small codecs of the delivery protocol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geometry import col, half_up

#: File extension to media type.
MEDIA_TYPES = {"html": "text/html; charset=utf-8", "css": "text/css; charset=utf-8", "js": "text/javascript; charset=utf-8", "json": "application/json; charset=utf-8", "png": "image/png", "jpg": "image/jpeg", "svg": "image/svg+xml", "ico": "image/x-icon"}
GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


def parse_message(text) -> Column:
    """struct(cmd, fields map, error): 400 for a bad command, a field without key, a bad or repeated key."""
    parts = F.split(col(text), r"\|", -1)
    cmd, rest = parts[0], F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    key = lambda p: F.substring_index(p, ":", 1)
    keys = F.transform(rest, key)
    good = cmd.rlike("^[A-Z_]+$") & F.forall(rest, lambda p: (F.instr(p, ":") > 1) & key(p).rlike("^[A-Z_]+$")) & (F.size(F.array_distinct(keys)) == F.size(keys))
    values = F.transform(rest, lambda p: F.substr(p, F.instr(p, ":") + 1))
    return F.struct(F.when(good, cmd).alias("cmd"), F.when(good, F.map_from_arrays(keys, values)).alias("fields"), F.when(~good, F.lit(400)).alias("error"))


def int_field(fields: Column, name: str, low: int, high: int) -> Column:
    """The field as a long, or null where it is missing, no integer or out of range."""
    raw = F.try_element_at(fields, F.lit(name))
    v = F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("long"))
    return F.when(v.between(low, high), v)


def serialise(cmd: str, fields: dict[str, Column]) -> Column:
    return F.concat_ws("|", F.lit(cmd), *[F.concat(F.lit(k + ":"), F.replace(v.cast("string"), F.lit("|"), F.lit("/"))) for k, v in fields.items()])


def image_id(name) -> Column:
    n = col(name)
    stem = F.when(n.rlike(r"^.+\.[^.]*$"), F.regexp_replace(n, r"\.[^.]*$", "")).otherwise(n)
    clean = F.substring(F.regexp_replace(stem, "[^A-Za-z0-9_-]", "_"), 1, 64)
    return F.when(clean == "", F.lit("imagen")).otherwise(clean)


def is_image_id(v) -> Column:
    return col(v).rlike(r"^[A-Za-z0-9_-]{1,64}$")


def is_candidate(name) -> Column:
    n = F.lower(col(name))
    out = n.startswith(".") | n.isin("desktop.ini", "thumbs.db")
    for tail in (".tmp", ".part", ".crdownload"):
        out = out | n.endswith(tail)
    return ~out


def progress_of(line) -> Column:
    got = F.regexp_extract(col(line), r"Franja\s+(\d+)/(\d+)", 1), F.regexp_extract(col(line), r"Franja\s+(\d+)/(\d+)", 2)
    return F.when(got[0] != "", F.least(F.lit(99), F.floor(100 * got[0].cast("long") / got[1].cast("long"))).cast("int"))


def duration(seconds) -> Column:
    s = col(seconds).cast("long")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))


def eta(seconds, i, n) -> Column:
    """Seconds left after band i of n."""
    return col(seconds) / (col(i) + 1) * (col(n) - col(i) - 1)


def fingerprint(size, modified_ms) -> Column:
    return F.concat(col(size).cast("string"), F.lit("/"), col(modified_ms).cast("string"))


def has_token(text, token: str) -> Column:
    return F.exists(F.split(F.lower(col(text)), ","), lambda t: F.trim(t) == token.lower())


def media_type(path) -> Column:
    ext = F.lower(F.substring_index(col(path), ".", -1))
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def safe_path(raw) -> Column:
    """Decoded path, or null where it climbs out of the root."""
    p = F.try_url_decode(F.split(col(raw), r"\?")[0])
    deep = F.aggregate(F.split(p, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, s: F.struct((a["d"] + F.when(s == "..", -1).when((s == "") | (s == "."), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(s == "..", -1).otherwise(0)).alias("low")))
    return F.when(deep["low"] >= 0, p)


def accept_key(key) -> Column:
    return F.base64(F.unhex(F.sha1(F.concat(col(key), F.lit(GUID)))))


def encode_list(id_, state, progress) -> Column:
    return F.concat_ws(",", col(id_), col(state), col(progress).cast("string"))


def decode_list(text) -> Column:
    """Array of struct(id, state, progress)."""
    part = lambda e: F.split(e, ",")
    return F.transform(F.split(col(text), ";"), lambda e: F.struct(part(e)[0].alias("id"), part(e)[1].alias("state"), part(e)[2].cast("int").alias("progress")))


def tile_text(z, x, y) -> Column:
    return F.concat_ws(",", col(z).cast("string"), col(x).cast("string"), col(y).cast("string"))


def cache_key(image, version, z, x, y) -> Column:
    """Key of a tile of one version of an image; a new version never meets an old tile."""
    return F.concat(col(image), F.lit("#"), F.concat_ws("/", *[col(v).cast("string") for v in (version, z, x, y)]))


def filter_bits(text) -> Column:
    """The 512 bytes of a filter from Base64, or null for anything else."""
    raw = F.try_to_binary(col(text), F.lit("base64"))
    return F.when(F.length(raw) == 512, raw)


def backoff_s(n) -> Column:
    return F.least(F.lit(30.0), F.pow(F.lit(2.0), col(n)))


def bytes_of(v: Column, n: int) -> Column:
    """Big-endian bytes of an unsigned integer."""
    return F.unhex(F.lpad(F.hex(v.cast("long")), 2 * n, "0"))


def int_at(frame: Column, at: int, n: int) -> Column:
    """Unsigned big-endian integer at a 0-based byte offset."""
    return F.conv(F.hex(F.substr(frame, F.lit(at + 1), F.lit(n))), 16, 10).cast("long")


def tile_frame(seq, num, z, x, y, fmt, payload) -> Column:
    data = col(payload)
    head = [F.lit(2), F.lit(1), col(seq), col(num), col(z), col(x), col(y), col(fmt), F.length(data), F.crc32(data)]
    return F.concat(*[bytes_of(v, n) for v, n in zip(head, (1, 1, 4, 4, 1, 4, 4, 1, 4, 4), strict=True)], data)


def read_tile_frame(frame) -> Column:
    f = col(frame)
    names = [("ver", 0, 1), ("kind", 1, 1), ("seq", 2, 4), ("num", 6, 4), ("z", 10, 1), ("x", 11, 4), ("y", 15, 4), ("fmt", 19, 1), ("len", 20, 4), ("crc", 24, 4)]
    return F.struct(*[int_at(f, at, n).alias(k) for k, at, n in names], F.substr(f, F.lit(29)).alias("data"))


def parity_frame(seq, num, members, payload) -> Column:
    """members: array of struct(z, x, y, fmt, len, crc)."""
    one = lambda m: F.concat(*[bytes_of(m[k], n) for k, n in (("z", 1), ("x", 4), ("y", 4), ("fmt", 1), ("len", 4), ("crc", 4))])
    body = F.unhex(F.array_join(F.transform(col(members), lambda m: F.hex(one(m))), ""))
    data = col(payload)
    head = [bytes_of(v, n) for v, n in ((F.lit(2), 1), (F.lit(2), 1), (col(seq), 4), (col(num), 4), (F.size(col(members)), 1))]
    return F.concat(*head, body, bytes_of(F.length(data), 4), bytes_of(F.crc32(data), 4), data)


def clamp_report(v, high: int) -> Column:
    return F.least(F.lit(high).cast("long"), F.greatest(F.lit(0).cast("long"), half_up(v)))
