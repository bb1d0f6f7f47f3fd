"""From image files to stored, verified pyramids, and the tables that say which are complete."""

from __future__ import annotations

import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.geometry import TILE, n_levels_expr
from tessera.functions.messages import image_id, is_candidate
from tessera.operators import pyramid
from tessera.sources import png, tile_store
from tessera.streaming.ingest import unseen

BANDS = "path string, x0 long, y0 long, width long, height long, data binary"


def formats(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """(path, img, format) of the files a pattern names, or of a list; the format is told by the first bytes, null if unknown."""
    paths = png.listed(pattern) if isinstance(pattern, str) else sorted(pattern)

    def heads(batches):
        for batch in batches:
            first = []
            for path in batch["path"].to_pylist():
                with png.opened(path) as file:
                    first.append(file.read(8))
            yield pa.RecordBatch.from_pydict({"path": batch["path"], "head": pa.array(first, pa.binary())})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    name = F.element_at(F.split("path", "/"), -1)
    return files.mapInArrow(heads, "path string, head binary").select("path", image_id(name).alias("img"), tile_store.format_of(F.col("head")).alias("format"))


def _png_bands(files: DataFrame, rows: int) -> DataFrame:
    def read(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                with png.opened(path) as file:
                    h = png.header(file.read(33))
                with png.opened(path) as file:
                    for y0, _, bgr in png.bands(file, rows):
                        yield pa.RecordBatch.from_pylist([{"path": path, "x0": 0, "y0": y0, "width": h["width"], "height": h["height"], "data": bgr}], to_arrow_schema(schema))

    schema = files.sparkSession.createDataFrame([], BANDS).schema
    return files.select("path").mapInArrow(read, schema)


def _other_bands(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Images of other formats by Spark's own reader, whole, as BGR without alpha; an unreadable one raises."""

    def bgr(batches):
        for batch in batches:
            data = [np.frombuffer(d.as_buffer(), np.uint8).reshape(-1, c.as_py()) for d, c in zip(batch["data"], batch["nChannels"])]
            data = [(np.repeat(d, 3, axis=1) if d.shape[1] == 1 else d[:, :3]).tobytes() for d in data]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("path", "x0", "y0", "width", "height")), pa.array(data, pa.binary())], schema=to_arrow_schema(schema))

    schema = spark.createDataFrame([], BANDS).schema
    image = spark.read.format("image").load(paths).select("image.*")
    sound = F.when(F.col("height") > 0, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), F.coalesce("origin", F.lit("?")))))
    long = lambda c, name: c.cast("long").alias(name)
    origin = F.try_url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))  # the reader gives paths as URLs
    return image.select(F.coalesce(origin, "origin").alias("path"), long(F.lit(0), "x0"), long(F.lit(0), "y0"), long(F.col("width"), "width"), long(sound, "height"), "nChannels", "data").mapInArrow(bgr, schema)


def bands(spark: SparkSession, pattern: str | list[str], rows: int = 256) -> DataFrame:
    """(img, x0, y0, width, height, data) of all images a pattern names, whatever their names' endings.

    PNG files go to the streaming reader, JPEG, BMP, TIFF and GIF to Spark's ``image`` source (whole, below 2 GB); ValueError names
    the files of no known format and those whose ids clash.
    """
    found = formats(spark, pattern).collect()  # one small row a file, as any listing
    unknown = sorted(r.path for r in found if r.format is None)
    ids = Counter(r.img for r in found)
    clash = sorted(r.path for r in found if ids[r.img] > 1)
    if unknown or clash:
        raise ValueError(f"of no known format: {unknown}; with clashing ids: {clash}")
    ours, others = ([r.path for r in found if (r.format == "png") == own] for own in (True, False))
    out = _png_bands(spark.createDataFrame([(p,) for p in ours], "path string").repartition(max(1, len(ours))), rows)
    out = out.unionByName(_other_bands(spark, others)) if others else out
    return out.withColumn("img", image_id(F.element_at(F.split("path", "/"), -1))).drop("path")


def encode(tiles: DataFrame) -> DataFrame:
    """Tiles of BGR bytes (img, z, tx, ty, w, h, data) as PNG files (img, z, x, y, bytes)."""

    def run(batches):
        for batch in batches:
            files = [png.encode(d.as_py(), w.as_py(), h.as_py()) for d, w, h in zip(batch["data"], batch["w"], batch["h"])]
            yield pa.RecordBatch.from_arrays([batch["img"], batch["z"], batch["tx"].cast(pa.int32()), batch["ty"].cast(pa.int32()), pa.array(files, pa.binary())], names=["img", "z", "x", "y", "bytes"])

    return tiles.mapInArrow(run, "img string, z int, x int, y int, bytes binary")


def _remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def delete(spark: SparkSession, store: str, img: str | None = None) -> None:
    """Removes one image's pyramid, or all of a store; the marker goes first."""
    for part in ("ready", "tiles"):
        _remove(spark, f"{store}/{part}" + (f"/img={img}" if img is not None else ""))


def backlog(files: DataFrame, ready: DataFrame) -> DataFrame:
    """At the start: files (path, img) without a pyramid wait as PROCESSING, the others are only noted as SEEN."""
    return files.join(ready.select("img", F.lit("SEEN").alias("s")).distinct(), "img", "left").select("path", "img", F.coalesce("s", F.lit("PROCESSING")).alias("state"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime in microseconds) of a folder's candidates; contents are not read."""
    from pyarrow import fs

    files, base = png.located(folder)
    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    rows = [(f"{folder}/{i.base_name}", i.base_name, i.size, i.mtime_ns // 1000) for i in found if i.is_file]
    return spark.createDataFrame(rows, "path string, name string, size long, mtime long").where(is_candidate("name")).drop("name")


def sweep(spark: SparkSession, folder: str, store: str, tile: int = TILE, quiet: int = 5, now: float | None = None) -> list[tuple[str, str]]:
    """One look at a folder: ingests, oldest first and one at a time, its files that are new or changed and have been
    left alone for ``quiet`` seconds; (path, READY or the error). A scheduler calls it again and again.

    ``store``/seen holds the fingerprints of what went in, so that a restart goes on where it was. A failed file is not
    noted and so is tried again.
    """
    noted = "path string, size long, mtime long"
    seen = spark.read.schema(noted).parquet(f"{store}/seen") if png.listed(f"{store}/seen/*") else spark.createDataFrame([], noted)
    still = (time.time() if now is None else now) - quiet
    out = []
    for f in unseen(_files(spark, folder), seen).where(F.col("mtime") <= int(still * 1e6)).orderBy("mtime", "path").collect():  # a listing's names
        try:
            ingest(spark, [f.path], store, tile)
            spark.createDataFrame([(f.path, f.size, f.mtime)], noted).coalesce(1).write.mode("append").parquet(f"{store}/seen")
            out.append((f.path, "READY"))
        except Exception as error:  # one bad file does not hold up the others; it is told and tried again
            out.append((f.path, str(error)))
    return out


def ingest(spark: SparkSession, pattern: str | list[str], store: str, tile: int = TILE, cut=None) -> DataFrame:
    """Writes the pyramids of all images of a pattern; returns (img, width, height, tile, levels, tiles).

    ``store``/tiles holds the tiles, ``store``/ready one partition an image that is complete: it is removed before the
    image's tiles are written and comes back once as many tiles are read as the layout has. Other images stay.
    RuntimeError names images that are not complete.
    """
    rows = bands(spark, pattern)
    images = rows.groupBy("img").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    images = images.withColumn("levels", n_levels_expr("width", "height", tile))
    known = images.collect()
    if not known:
        return spark.createDataFrame([], "img string, width long, height long, tile int, levels int, tiles long")
    table = spark.createDataFrame(known, images.schema)
    for r in known:
        _remove(spark, f"{store}/ready/img={r.img}")
    numbered = rows.join(F.broadcast(table.select("img", F.col("levels").alias("n"))), "img")  # one row an image of this call
    made = pyramid.build(numbered, max(r.levels for r in known), 3, tile, max(2048, 2 * tile), cut)
    tile_store.write(encode(made), f"{store}/tiles")
    want = pyramid.levels(table.select("img", "width", "height"), tile).groupBy("img").agg(F.sum("tiles").alias("tiles"))
    have = tile_store.read(spark, f"{store}/tiles").join(table.select("img"), "img", "left_semi").groupBy("img").agg(F.count("*").alias("found"))
    bad = [r.img for r in want.join(have, "img", "left").where("found is null or found <> tiles").collect()]
    if bad:
        raise RuntimeError(f"not complete: {sorted(bad)}")
    ready = table.join(want, "img").select("img", "width", "height", F.lit(tile).alias("tile"), "levels", "tiles")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("img").parquet(f"{store}/ready")
    return ready


def scan(spark: SparkSession, pattern: str | list[str], inflate: bool = False) -> DataFrame:
    """What PNG files say of themselves, pixels unread; with ``inflate`` also the bytes they inflate to.

    (path, width, height, channels, expected, level, block, inflated): ``expected`` bytes of a sound image, ``level`` the
    compressor's stated effort (0 to 3), ``block`` the first block's kind (0 stored, 1 fixed, 2 dynamic codes).
    """
    paths = png.listed(pattern) if isinstance(pattern, str) else sorted(pattern)

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                with png.opened(path) as file:
                    h = png.header(file.read(33))
                    first = b""
                    for piece in png.compressed(file):
                        if len(first := first + piece) > 2:
                            break
                row = {"path": path, "width": h["width"], "height": h["height"], "channels": h["channels"], "expected": png.expected_bytes(h["width"], h["height"], h["channels"])}
                row |= {"level": first[1] >> 6, "block": first[2] >> 1 & 3} if len(first) > 2 else {"level": None, "block": None}
                row["inflated"] = None
                if inflate:
                    with png.opened(path) as file:
                        file.read(33)
                        row["inflated"] = sum(map(len, png.inflated(file)))
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    fields = "path string, width int, height int, channels int, expected long, level int, block int, inflated long"
    schema = to_arrow_schema(spark.createDataFrame([], fields).schema)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000))).mapInArrow(run, fields)
