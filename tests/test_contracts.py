"""Fixed values that any implementation of the engine must reproduce."""

import hashlib
import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import hashing as H
from tessera.functions import messages as M
from tessera.operators import cache, control, pyramid, viewport
from tessera.plans import catalog
from tessera.sources import ingest as ingest_files
from tessera.sources import png, tile_store

HASHES = [
    (0, 0, 0, 0, "da0f62ef", "c1eeb577", [751, 2150, 3549, 852, 2251, 3650, 953]),
    (0, 3, 2, 1, "6f0995ef", "a0e26c1b", [1519, 522, 3621, 2624, 1627, 630, 3729]),
    (0, 10, 689, 689, "aa361541", "e7cbfa79", [1345, 4026, 2611, 1196, 3877, 2462, 1047]),
    (1, 0, 0, 0, "8187a466", "0d1c23d9", [1126, 2111, 3096, 4081, 970, 1955, 2940]),
    (1, 3, 2, 1, "ec8d7166", "cac4047f", [358, 1509, 2660, 3811, 866, 2017, 3168]),
    (1, 10, 689, 689, "0cc2a54c", "1a040545", [1356, 2705, 4054, 1307, 2656, 4005, 1258]),
]


def test_hash_contract(spark):
    df = spark.createDataFrame([h[:4] for h in HASHES], "sem long, z long, x long, y long")
    h1, h2 = H.hash_pair("sem", "z", "x", "y")
    got = df.withColumn("h1", h1).withColumn("h2", h2).withColumn("p", H.positions_of(F.col("h1"), F.col("h2"))).collect()
    want = {h[:4]: (int(h[4], 16), int(h[5], 16), h[6]) for h in HASHES}
    for r in got:
        assert (r.h1, r.h2, r.p) == want[(r.sem, r.z, r.x, r.y)]


def test_layouts(spark):
    got = {r.img: (r.n_levels, r.total_tiles, r.top_tiles) for r in catalog.QUERIES["pyramid_totals"](spark, "").collect()}
    want = [(9, 24796, 18526), (10, 180189, 134937), (11, 635214, 476100), (9, 27660, 20736), (6, 723, 529), (10, 116274, 87025), (10, 191840, 143641), (11, 379388, 284089)]
    assert [got[i] for i in range(8)] == want
    assert G.n_levels(36743, 36743) == 9


def test_reduction_replicates_odd_edges(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 256, (5, 7))
    df = spark.createDataFrame([(x, y, int(v[y, x])) for y in range(5) for x in range(7)], "x long, y long, v int")
    got = {(r.x, r.y): r.v for r in pyramid.reduce_level(df, ["v"]).collect()}
    for y in range(3):
        for x in range(4):
            cells = [v[min(2 * y + j, 4), min(2 * x + i, 6)] for j in (0, 1) for i in (0, 1)]
            assert got[(x, y)] == (sum(map(int, cells)) + 2) >> 2


def test_deadline_and_distance(spark):
    r = spark.range(1).select(G.deadline(F.lit(0), F.lit(0.5)).alias("a"), G.deadline(F.lit(0), F.lit(4.0)).alias("b"), G.floor_div(F.lit(-1), 256).alias("c")).first()
    assert (r.a, r.b, r.c) == (42_500_000, 130_000_000, -1)


@pytest.mark.parametrize("n,want", [(16, [4, 4, 4, 4]), (40, [4, 4, 4, 4]), (5, [3, 2]), (1, [])])
def test_parity_groups(spark, n, want):
    df = spark.range(n).select(F.lit(1).alias("session"), F.lit(1).alias("seq"), F.col("id").alias("rank"), (F.col("id") * 10).alias("deadline"))
    got = viewport.parity_groups(df).orderBy("grp").collect()
    assert [r.members for r in got] == want
    if n == 16:
        assert [r.deadline for r in got] == [1_000_120, 1_000_130, 1_000_140, 1_000_150]


def test_controller_steps(spark):
    rows = [(1, 1, 20.0, 0.1, True), (1, 2, 4.0, 0.1, True)] + [(2, i, 0.0, 0.1, False) for i in range(100)] + [(3, i, 0.0, 0.1, True) for i in range(200)]
    got = control.pi_series(spark.createDataFrame(rows, "session long, ord long, q double, dt double, demand boolean")).collect()
    by = {(r.session, r.ord): r for r in got}
    assert by[(1, 1)].rate == 4.0 and by[(1, 1)].integral == 0.0
    assert by[(1, 2)].rate == pytest.approx(59.2)
    assert by[(2, 99)].rate == 72.0 and by[(2, 99)].integral == 0.0
    assert by[(3, 199)].rate == 400.0 and by[(3, 199)].integral == by[(3, 150)].integral


def test_loss_draws(spark):
    rng = control.JavaRandom(42)
    assert sum(rng.below(100) < 5 for _ in range(100_000)) == 5010


def test_link(spark):
    m = spark.range(100).select(F.lit(1).alias("session"), F.col("id").alias("ord"), F.lit(0).cast("long").alias("now_ns"), F.lit(10_000).cast("long").alias("bytes"))
    got = [r.out_ns // 1_000_000 for r in control.link_departures(m, 100, 80).orderBy("ord").collect()]
    assert got[0] == 180 and got[-1] == 10_080


def test_caches_on_hot_set_and_sweep():
    trace = []
    for rnd in range(50):
        hot = [f"hot/{i}" for i in range(60)]
        trace += [(k, rnd) for k in hot + hot] + [(f"sweep/{rnd}/{i}", rnd) for i in range(150)]
    rates = {}
    for name, make in cache.POLICIES.items():
        c, hits, asked = make(1_000_000), 0, 0
        seen = set()
        for key, rnd in trace:
            first = (key, rnd) not in seen
            seen.add((key, rnd))
            hit = c.get(key)
            if not hit:
                c.put(key, 10_000)
            if key.startswith("hot") and first and rnd:
                asked, hits = asked + 1, hits + hit
        rates[name] = hits / asked
    assert rates == {"lru": 0.0, "arc": 1.0}


def test_offsets_begin_anew_for_every_image(spark):
    t = spark.createDataFrame([("a", 0, 0, 0, 5), ("b", 0, 0, 0, 7), ("b", 0, 1, 0, 2)], "img string, z int, x long, y long, length long")
    assert {(r.img, r.x): r.offset for r in pyramid.index(t, 4).collect()} == {("a", 0): 0, ("b", 0): 0, ("b", 1): 7}


def test_large_quotients_keep_all_digits(spark):
    r = spark.range(1).select(G.floor_div(F.lit((1 << 62) + 1), 2).alias("a"), G.floor_div(F.lit(-((1 << 62) + 1)), 2).alias("b"), G.ceil_div(F.lit((1 << 62) + 1), 2).alias("c")).first()
    assert (r.a, r.b, r.c) == (1 << 61, -(1 << 61) - 1, (1 << 61) + 1)


def test_arc_stays_within_its_bounds():
    rng = np.random.default_rng(4)
    c, sizes = cache.Arc(100_000), {k: int(n) for k, n in enumerate(rng.integers(1000, 31_000, 300))}
    for k in rng.integers(0, 300, 20_000).tolist():
        if not c.get(str(k)):
            c.put(str(k), sizes[k])
        kept = [(t, n) for t, n, _ in c.items.values()]
        assert [sum(n for t, n in kept if t == i) for i in range(4)] == c.bytes and [sum(t == i for t, _ in kept) for i in range(4)] == c.count
        assert c.bytes[0] + c.bytes[1] <= 100_000 and sum(c.bytes) <= 200_000 and 0 <= c.target <= 100_000
    assert not c.peek("none") and c.peek(next(k for k, v in c.items.items() if v[0] < 2))


def test_lru_forms_agree(spark):
    rng = np.random.default_rng(5)
    rows = [("t", i, "get", f"k{k}", 100 + 7 * int(k)) for i, k in enumerate(rng.integers(0, 40, 600))]
    t = spark.createDataFrame(rows, "trace string, ord long, op string, key string, bytes long")
    a = {r.ord: r.hit for r in cache.replay(t, "lru", 3000).collect()}
    assert a == {r.ord: r.hit for r in cache.lru_by_distance(t, 3000).collect()}


def test_pyramid_of_several_passes(spark, tmp_path):
    """Two images of odd sizes, bands of any height, blocks of two tiles a side: five levels take four shuffles."""
    rng, tile = np.random.default_rng(2), 4
    images = {"a": rng.integers(0, 256, (61, 37, 3), dtype=np.uint8), "b": rng.integers(0, 256, (3, 9, 3), dtype=np.uint8)}
    rows = []
    for img, p in images.items():
        n = next(k + 1 for k in range(9) if -(-max(p.shape[:2]) // 2**k) <= tile)
        for y in range(0, len(p), 5):
            for x, w in ((0, p.shape[1] // 2), (p.shape[1] // 2, -(-p.shape[1] // 2))):
                rows.append((img, n, x, y, w, p[y : y + 5, x : x + w].tobytes()))
    bands = spark.createDataFrame(rows + [("a", 5, 0, 0, 1, None)], "img string, n int, x0 long, y0 long, width int, data binary").repartition(3)
    cuts = iter(range(9))

    def cut(df):
        path = f"{tmp_path}/{next(cuts)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    got = {(r.img, r.z, r.tx, r.ty): np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 3) for r in pyramid.build(bands, 5, 3, tile, 8, cut).collect()}
    seen = 0
    for img, p in images.items():
        n = max(z for i, z, _, _ in got if i == img) + 1
        for z in range(n - 1, -1, -1):
            for ty in range(-(-len(p) // tile)):
                for tx in range(-(-p.shape[1] // tile)):
                    seen += 1
                    assert (got[img, z, tx, ty] == p[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]).all()
            blocks = [[p[y : y + 2, x : x + 2].reshape(-1, 3).astype(int) for x in range(0, p.shape[1], 2)] for y in range(0, len(p), 2)]
            p = np.array([[(2 * b.sum(0) + len(b)) // (2 * len(b)) for b in row] for row in blocks], np.uint8)
    assert seen == len(got) and {z for i, z, _, _ in got if i == "a"} == set(range(5))
    assert pyramid.build(bands.where("false"), 5, 3, tile, 8).count() == 0
    with pytest.raises(Exception, match="missing or repeated"):
        pyramid.build(bands.where("y0 <> 5"), 1, 3, tile, 8).count()


def _against_sql(spark, name, folder, tables):
    """Rows of a query and of its SQL over tables of a folder, in order."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("name", ["pyramid_images", "tile_bytes", "tile_cut_stats", "pyramid_build_level_means", "pyramid_rgb_edges"])
def test_pyramid_queries_at_any_height(spark, tmp_path, name):
    """More rows than six levels bring down to one tile, a number not divisible by four, and a gap in the rows."""
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.uniform(-1, 1, (1043, 64)).astype(np.float32)) if i not in (5, 6, 7, 40) and not 96 <= i < 128]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = _against_sql(spark, name, tmp_path, ["embeddings"])
    assert len(got) > 100 and got == want


def test_pyramid_with_holes_over_several_blocks(spark):
    """Holes weigh nothing at any level, also where tiles go through a second shuffle; repeated pixels raise."""
    rng = np.random.default_rng(8)
    tile, size = 2, 40
    level = {(int(x), int(y)): rng.integers(0, 256, 2) for x, y in rng.integers(0, size, (500, 2))}
    rows = [("i", 6, x, y, 1, bytes(v.astype(np.uint8))) for (x, y), v in level.items()]
    bands = spark.createDataFrame(rows, "img string, n int, x0 int, y0 int, width int, data binary")
    made = pyramid.build(bands, 6, 2, tile, 4, holes=True)
    got = {(r.z, r.x, r.y): (r.a, r.b) for r in pyramid.pixels_of(made, ["a", "b"], tile, holes=True).collect()}
    want = {}
    for z in range(5, -1, -1):
        want |= {(z, x, y): (int(v[0]), int(v[1])) for (x, y), v in level.items()}
        cells = {}
        for (x, y), v in level.items():
            cells.setdefault((x // 2, y // 2), []).append(v)
        level = {k: (2 * sum(map(np.int64, v)) + len(v)) // (2 * len(v)) for k, v in cells.items()}
    assert got == want
    with pytest.raises(Exception, match="repeated"):
        pyramid.build(bands.unionByName(bands.limit(1)), 6, 2, tile, 4, holes=True).count()


def test_attempts_follow_the_fold(spark):
    """Long histories of one path, failures and null fingerprints, against the fold; no list of a path's arrivals is made."""
    from tessera.operators import session

    rng = np.random.default_rng(9)
    rows, want = [], set()
    for path, n in (("a", 3000), ("b", 500), ("c", 1)):
        last = None
        for k in range(n):
            fp, ok = [None, "x", "y"][rng.integers(0, 3)], bool(rng.integers(0, 2))
            taken = fp != last
            last = (fp if ok else None) if taken else last
            rows.append((path, k, fp, ok))
            want.add((path, k, taken))
    out = session.attempts(spark.createDataFrame(rows, "path string, ord int, fingerprint string, ok boolean"))
    assert {tuple(r) for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_png_round_trip_and_filters(spark, tmp_path):
    import struct
    import zlib

    rng = np.random.default_rng(1)
    bgr = rng.integers(0, 256, (9, 5, 3), dtype=np.uint8)
    assert b"".join(b for _, _, b in png.bands(png.encode(bgr.tobytes(), 5, 9), 4)) == bgr.tobytes()
    # every filter, against Spark's own image reader
    rgb, rows, above = bgr[:, :, ::-1].reshape(9, -1).astype(int), [], np.zeros(15, int)
    for y in range(9):
        kind, row = y % 5, rgb[y]
        left, corner = np.concatenate((np.zeros(3, int), row[:-3])), np.concatenate((np.zeros(3, int), above[:-3]))
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * row, left, above, (left + above) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))][kind]
        rows.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    z = zlib.compress(b"".join(rows))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", z[:7]) + chunk(b"IDAT", b"") + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(data)
    png.register(spark)
    got = spark.read.format("png_bands").option("path", f"{tmp_path}/*.png").option("rows", 4).load().orderBy("band").collect()
    assert b"".join(bytes(r.bgr) for r in got) == bgr.tobytes()
    assert bytes(spark.read.format("image").load(f"{tmp_path}/a.png").select("image.data").first()[0]) == bgr.tobytes()
    with pytest.raises(EOFError):
        list(png.bands(png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows[:3]))), 4))


def test_ingest_of_files(spark, tmp_path):
    """Formats by signature, tiles read back equal to the pixels, the marker last, and errors by name."""
    import struct
    import zlib

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (37, 21, 3), dtype=np.uint8), rng.integers(0, 256, (9, 12, 3), dtype=np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(png.encode(a.tobytes(), 21, 37))
    body = b[::-1].tobytes()  # rows of 36 bytes need no padding
    (tmp_path / "in/b c.png").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 12, 9, 1, 24, 0, len(body), 0, 0, 0, 0) + body)
    for _ in range(2):  # again, over what is there
        got = {r.img: r for r in ingest_files.ingest(spark, f"{tmp_path}/in/*", f"{tmp_path}/store", 8).collect()}
    assert {k: (r.width, r.height, r.levels, r.tiles) for k, r in got.items()} == {"a": (21, 37, 4, 15 + 6 + 2 + 1), "b_c": (12, 9, 2, 4 + 1)}
    assert spark.read.parquet(f"{tmp_path}/store/ready").count() == 2
    for img, p, top in (("a", a, 3), ("b_c", b, 1)):
        tiles = tile_store.read(spark, f"{tmp_path}/store/tiles").where(f"img = '{img}' and z = {top}").collect()
        assert len(tiles) == -(-p.shape[0] // 8) * -(-p.shape[1] // 8)
        for t in tiles:
            part = p[t.y * 8 : t.y * 8 + 8, t.x * 8 : t.x * 8 + 8]
            assert b"".join(x for _, _, x in png.bands(bytes(t.bytes), 8)) == part.tobytes()
    (tmp_path / "in/c.png").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="c.png"):
        ingest_files.ingest(spark, f"{tmp_path}/in/*", f"{tmp_path}/store", 8)
    data = zlib.compress(bytes(9 * (1 << 20)))
    assert max(len(x) for x in png.inflated(__import__("io").BytesIO(struct.pack(">I4s", len(data), b"IDAT") + data + bytes(4)))) <= png.PIECE


def test_sweeps_of_a_folder(spark, tmp_path):
    """New files once, changed files again, failed files again until they are mended, young files not yet."""
    import os

    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    os.mkdir(folder)
    image = np.arange(6 * 5 * 3, dtype=np.uint8).reshape(6, 5, 3)

    def put(name, data, at):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
        os.utime(f"{folder}/{name}", (at, at))

    sweep = lambda now: [(p.rsplit("/", 1)[1], s if s == "READY" else "ERROR") for p, s in ingest_files.sweep(spark, folder, store, 8, now=now)]
    put("b.png", png.encode(image.tobytes(), 5, 6), 100)
    put("a.png", b"torn", 101)
    put("young.png", png.encode(image.tobytes(), 5, 6), 108)
    assert sweep(110) == [("b.png", "READY"), ("a.png", "ERROR")]
    put("a.png", png.encode(image.tobytes(), 5, 6), 102)
    assert sweep(110) == [("a.png", "READY")] and sweep(110) == []
    put("b.png", png.encode(image[:3].tobytes(), 5, 3), 104)
    assert sweep(110) == [("b.png", "READY")]
    assert {r.img: r.height for r in spark.read.parquet(f"{store}/ready").collect()} == {"a": 6, "b": 3}
    files = ingest_files.formats(spark, f"{folder}/*")
    assert {r.img: r.state for r in ingest_files.backlog(files, spark.read.parquet(f"{store}/ready")).collect()} == {"a": "SEEN", "b": "SEEN", "young": "PROCESSING"}
    said = {r.path[-5:]: r for r in ingest_files.scan(spark, f"{folder}/?.png", inflate=True).collect()}
    assert (said["a.png"].width, said["a.png"].height, said["a.png"].expected, said["a.png"].inflated, said["b.png"].inflated) == (5, 6, 96, 96, 48)
    with png.opened(f"{folder}/a.png") as file:
        assert png.region(file, 3, 4, 9, 9) == image[4:, 3:].tobytes() == png.region(png.encode(image.tobytes(), 5, 6), 3, 4, 9, 9)
    ingest_files.delete(spark, store, "a")
    assert [r.img for r in spark.read.parquet(f"{store}/ready").collect()] == ["b"]


def test_codecs(spark):
    r = spark.range(1).select(M.accept_key(F.lit("dGhlIHNhbXBsZSBub25jZQ==")).alias("k"), M.media_type(F.lit("/a/b.PNG")).alias("m"), M.safe_path(F.lit("/a/../../b")).alias("bad"), M.safe_path(F.lit("/a/%20b")).alias("ok"), M.image_id(F.lit("a b.tar.gz")).alias("i"), M.image_id(F.lit(".x")).alias("j")).first()
    assert (r.k, r.m, r.bad, r.ok, r.i, r.j) == ("s3pPLMBiTxaQ9kYGzzhZRbK+xOo=", "image/png", None, "/a/ b", "a_b_tar", "_x")
    assert tile_store.read_index(tile_store.index_bytes(2, 1, [(0, 5), (5, 0)])) == (2, 1, [(0, 5), (5, 0)])


def test_store_round_trip(spark, tmp_path):
    t = spark.range(50).select(F.lit("a").alias("img"), F.lit(1).alias("z"), (F.col("id") % 7).cast("int").alias("x"), (F.col("id") / 7).cast("int").alias("y"), F.col("id").cast("string").cast("binary").alias("bytes"))
    tile_store.write(t, f"{tmp_path}/s")
    back = tile_store.read(spark, f"{tmp_path}/s").where("z = 1 and x = 3 and y = 2")
    assert bytes(back.first().bytes) == b"17"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLES or name.startswith(("pyramid_b", "pyramid_r", "tile_cut", "tile_b")) and len(got) == 0:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_parity_covers_every_document(spark, tmp_path):
    texts = {i: None if i % 11 == 5 else f"{i}:" + "aé" * (i * 7 % 23) for i in range(203) if i % 13 != 4}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in texts.items():
        b, have = (t or "").encode(), want.get(i // 4, b"")
        want[i // 4] = bytes(x ^ y for x, y in itertools.zip_longest(have, b, fillvalue=0))
    got = {r.grp: (r.length, r.parity_md5) for r in catalog.QUERIES["fec_parity"](spark, str(tmp_path)).collect()}
    assert got == {g: (len(b), hashlib.md5(b.hex().upper().encode()).hexdigest()) for g, b in want.items()}
    back = {r.grp: (r.length, r.payload_md5) for r in catalog.QUERIES["fec_reconstruct"](spark, str(tmp_path)).collect()}
    assert back == {i // 4: (len(t.encode()), hashlib.md5(t.encode().hex().upper().encode()).hexdigest()) for i, t in texts.items() if i % 4 == 0 and t}


def test_every_holdings_filter_is_measured(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(i), int(u)) for i, u in enumerate(rng.zipf(1.3, 3000) % 37)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    keys = {tuple(r) for r in catalog.QUERIES["bloom_positions"](spark, str(tmp_path)).groupBy("session", "sem", "z", "x", "y").agg(F.sort_array(F.collect_set("pos"))).collect() for r in [(*r[:5], tuple(r[5]))]}
    held = {}
    for session, sem, *_, pos in keys:
        held.setdefault((session, sem), set()).update(pos)
    want = {(s, m, sum(k[1] == m for k in keys), sum(k[1] == m and b.issuperset(k[5]) for k in keys)) for (s, m), b in held.items()}
    assert {tuple(r) for r in catalog.QUERIES["bloom_fp_rate"](spark, str(tmp_path)).collect()} == want


def test_geometry_of_every_tile(spark):
    t = catalog.QUERIES["tile_geometry"](spark, "")
    got = {(r.img, r.z): r for r in t.groupBy("img", "z").agg(F.count("*").alias("tiles"), F.countDistinct("key").alias("keys"), F.bool_and("there").alias("there"), F.sum(F.when(F.col("y") == 0, F.col("tw"))).alias("w"), F.sum(F.when(F.col("x") == 0, F.col("th"))).alias("h"), F.max_by("tw", "x").alias("tw"), F.max_by("th", "y").alias("th"), F.bool_and((F.col("parent_x") == F.floor(F.col("x") / 2)) & (F.col("parent_y") == F.floor(F.col("y") / 2)) & (F.col("anc3_x") == F.floor(F.col("x") / 8)) & (F.col("anc3_y") == F.floor(F.col("y") / 8))).alias("up")).collect()}
    plan = catalog.QUERIES["pyramid_plan"](spark, "").collect()
    assert len(got) == len(plan)
    for p in plan:
        r = got[p.img, p.z]
        assert (r.tiles, r.keys, r.w, r.h, r.tw, r.th) == (p.tiles, p.tiles, p.w, p.h, (p.w - 1) % 256 + 1, (p.h - 1) % 256 + 1) and r.there and r.up


def test_streams(spark, tmp_path):
    from tessera.streaming import ingest

    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 2, 4, 20, 21)] + [("b", "2024-01-01 00:10:00")]
    spark.createDataFrame(rows, "path string, ts string").selectExpr("path", "cast(ts as timestamp) ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("path string, ts timestamp").parquet(f"{tmp_path}/in")
    q = ingest.live_quiet_periods(s).writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert sorted(r.n_events for r in spark.table("quiet").collect() if r.path == "a") == [2, 3]
    msgs = [(1, 1, "LIST"), (1, 2, "HELLO"), (1, 3, "OPEN"), (1, 4, "VIEWPORT"), (1, 5, "RESUME"), (2, 1, "NOPE")]
    spark.createDataFrame(msgs, "session long, ord long, cmd string").coalesce(1).write.parquet(f"{tmp_path}/msgs")
    live = ingest.live_session_states(spark.readStream.schema("session long, ord long, cmd string").parquet(f"{tmp_path}/msgs"))
    q = live.writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.awaitTermination(120)
    assert sorted((r.session, r.ord, r.code) for r in spark.table("states").collect()) == [(1, 1, 412), (1, 2, 0), (1, 3, 0), (1, 4, 0), (1, 5, 412), (2, 1, 400)]
    batch = ingest.quiet_periods(spark.read.parquet(f"{tmp_path}/in")).collect()
    assert sorted(r.n_events for r in batch) == [1, 2, 3]
