"""Tile store and catalog: Parquet by image and level, packed index codec, image formats."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = T.StructType([T.StructField("ancho", T.IntegerType()), T.StructField("alto", T.IntegerType()), T.StructField("tile", T.IntegerType()), T.StructField("formato", T.StringType()), T.StructField("niveles", T.IntegerType())])


def write(tiles: DataFrame, path: str) -> None:
    """Tiles (img, z, x, y, bytes) in row-major order of each level; ``_SUCCESS`` is the commit marker."""
    ordered = tiles.repartitionByRange(F.col("img"), F.col("z"), F.col("y"), F.col("x")).sortWithinPartitions("img", "z", "y", "x")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("img", "z").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("x int, y int, bytes binary, img string, z int").parquet(path)


def format_of(content: Column) -> Column:
    """The image format by its first bytes, whatever the file's name."""
    first = lambda n: F.hex(F.substr(content, F.lit(1), F.lit(n)))
    return F.when(first(8) == "89504E470D0A1A0A", "png").when(first(3) == "FFD8FF", "jpeg").when(first(2) == "424D", "bmp").when(first(4).isin("49492A00", "4D4D002A"), "tiff").when(first(4) == "47494638", "gif")


def parse_meta(text: Column) -> Column:
    return F.from_json(text, META)


def index_bytes(cols: int, rows: int, entries: list[tuple[int, int]]) -> bytes:
    """Index file: magic, version, columns, rows, then (offset, length) of every slot; length 0 is absent."""
    return b"PIDX" + struct.pack(">BxxxII", 1, cols, rows) + b"".join(struct.pack(">QI", o, n) for o, n in entries)


def read_index(data: bytes) -> tuple[int, int, list[tuple[int, int]]]:
    if data[:4] != b"PIDX" or data[4] != 1:
        raise ValueError("unknown index")
    cols, rows = struct.unpack(">II", data[8:16])
    if len(data) != 16 + 12 * cols * rows:
        raise ValueError("index size does not match its grid")
    return cols, rows, [struct.unpack(">QI", data[16 + 12 * i : 28 + 12 * i]) for i in range(cols * rows)]


def catalog(stored: DataFrame, ingesting: DataFrame) -> DataFrame:
    """(id, state, progress): stored images are READY, those being ingested override them."""
    ready = stored.select("id", F.lit("READY").alias("s"), F.lit(100).alias("p"))
    both = ready.join(ingesting.select("id", F.col("state").alias("s2"), F.col("progress").alias("p2")), "id", "full_outer")
    return both.select("id", F.coalesce("s2", "s").alias("state"), F.coalesce("p2", "p").cast("int").alias("progress"))
