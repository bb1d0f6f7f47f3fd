"""PNG reading by bands and writing of tiles, without any imaging library.

``spark.read.format("png_bands")`` (after ``register``) reads each image as rows of full-width bands; a partition is an
image. Files are read as streams through Arrow's file systems (local, HDFS, object stores by URI) and inflated by bounded
pieces; a band leaves as soon as it is decoded, so memory stays at one band and some ``WAVE`` bytes of rows being decoded.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIGNATURE = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])
CHANNELS = {0: 1, 2: 3, 6: 4}
PIECE = 1 << 20
#: Bytes of the decoder's skewed rows.
WAVE = 64 << 20
SCHEMA = "path string, band int, y0 int, width int, height int, bgr binary"


def header(data: bytes) -> dict:
    """Dimensions and channels; ValueError for what is not an 8-bit, non-interlaced gray, RGB or RGBA image."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or struct.unpack(">I", data[8:12])[0] != 13:
        raise ValueError("not a PNG")
    w, h, bits, colour, compression, filtering, interlace = struct.unpack(">IIBBBBB", data[16:29])
    if not 0 < w <= (1 << 31) // 4 or not 0 < h <= (1 << 31) // 4:
        raise ValueError("dimensions out of range")
    if bits != 8 or compression or filtering or interlace or colour not in CHANNELS:
        raise ValueError("unsupported PNG variant")
    return {"width": w, "height": h, "channels": CHANNELS[colour], "colour": colour}


def expected_bytes(width: int, height: int, channels: int) -> int:
    """Bytes that a sound image inflates to."""
    return height * (1 + width * channels)


def compressed(file: BinaryIO) -> Iterator[bytes]:
    """The IDAT chunks' contents by pieces, from the first chunk on; the first other chunk after them ends it."""
    begun = False
    while len(head := file.read(8)) == 8:
        n, kind = struct.unpack(">I4s", head)
        if kind != b"IDAT" and begun:
            return
        begun, left = begun or kind == b"IDAT", n + 4
        while left:
            piece = file.read(min(left, PIECE))
            if not piece:
                return
            if kind == b"IDAT" and left > 4:
                yield piece[: left - 4]
            left -= len(piece)


def inflated(file: BinaryIO) -> Iterator[bytes]:
    """The image's filtered rows, by pieces of bounded size whatever their compression."""
    inflate = zlib.decompressobj()
    for piece in compressed(file):
        while piece:
            yield inflate.decompress(piece, PIECE)
            piece = inflate.unconsumed_tail


def unfilter(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows (rows, pixels, channels) without their filters, modulo 256; ``above`` is the row before them.

    A pixel needs those left, above and above left of it, so all pixels on one anti-diagonal are decoded at once: pixel x
    of row r lies at [x + r + 1, r] of a skewed array whose cells outside the image are 0.
    """
    if kinds.max() > 4:
        raise ValueError(f"unknown filter {kinds.max()}")
    if (kinds < 3).all():  # nothing but running sums, of channels or of rows
        rows = rows.copy()
        rows[kinds == 1] = np.cumsum(rows[kinds == 1], axis=1, dtype=np.uint8)
        for r in np.flatnonzero(kinds == 2):
            rows[r] += rows[r - 1] if r else above
        return rows
    n, width, channels = rows.shape
    skew = np.zeros((width + n + 2, n + 1, channels), np.int16)
    for r, row in enumerate([above, *rows]):
        skew[r + 1 : r + 1 + width, r] = row
    sub, up, mean, paeth = ((kinds == k).astype(np.int16)[:, None] for k in (1, 2, 3, 4))
    for t in range(1, width + n):
        lo, hi = max(1, t - width + 1), min(n, t) + 1
        at = slice(lo - 1, hi - 1)
        left, over, corner = skew[t, lo:hi], skew[t, at], skew[t - 1, at]
        da, db, dc = abs(over - corner), abs(left - corner), abs(left + over - 2 * corner)
        nearest = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, over, corner))
        guess = left * sub[at] + over * up[at] + ((left + over) >> 1) * mean[at] + nearest * paeth[at]
        skew[t + 1, lo:hi] = (skew[t + 1, lo:hi] + guess) & 255
    return np.stack([skew[r + 1 : r + 1 + width, r] for r in range(1, n + 1)]).astype(np.uint8)


def to_bgr(pixels: np.ndarray) -> np.ndarray:
    """Gray is repeated, colours are turned round, alpha is dropped without blending."""
    return np.repeat(pixels, 3, axis=-1) if pixels.shape[-1] == 1 else pixels[..., 2::-1]


def bands(data: bytes | BinaryIO, rows: int) -> Iterator[tuple[int, int, bytes]]:
    """(first row, rows, BGR bytes) in order; EOFError for truncated data."""
    file = io.BytesIO(data) if isinstance(data, bytes) else data
    h = header(file.read(33))
    width, height, channels = h["width"], h["height"], h["channels"]
    stride, held, y, y0, out = 1 + width * channels, bytearray(), 0, 0, []
    above, wave = np.zeros((width, channels), np.uint8), max(1, min(rows, 256, WAVE // (2 * width * channels)))

    def decode(n: int) -> np.ndarray:
        raw = np.frombuffer(bytes(held[: n * stride]), np.uint8).reshape(n, stride)
        del held[: n * stride]
        return unfilter(raw[:, 0], raw[:, 1:].reshape(n, width, channels), above)

    for piece in inflated(file):
        held += piece
        while y < height and len(held) >= stride * (n := min(wave, y0 + rows - y, height - y)):
            done = decode(n)
            above, y = done[-1], y + n
            out.append(to_bgr(done).tobytes())
            if y in (y0 + rows, height):
                yield y0, y - y0, b"".join(out)
                y0, out = y, []
    if y < height:
        raise EOFError(f"truncated at row {y + len(held) // stride}")


def region(data: bytes | BinaryIO, x: int, y: int, width: int, height: int) -> bytes:
    """BGR bytes of a rectangle, cut at the image's edges; rows below it are not decoded."""
    head = data[:33] if isinstance(data, bytes) else data.read(33)
    full, out = header(head)["width"], []
    rest = data if isinstance(data, bytes) else _After(head, data)
    for y0, n, bgr in bands(rest, 64):
        rows = np.frombuffer(bgr, np.uint8).reshape(n, full, 3)
        out.append(rows[max(0, y - y0) : max(0, y + height - y0), x : x + width].tobytes())
        if y0 + n >= y + height:
            break
    return b"".join(out)


class _After:
    """A stream whose first bytes were read already."""

    def __init__(self, head: bytes, file: BinaryIO):
        self.head, self.file = head, file

    def read(self, n: int) -> bytes:
        if not self.head:
            return self.file.read(n)
        out, self.head = self.head[:n], self.head[n:]
        return out


def encode(bgr: bytes, width: int, height: int) -> bytes:
    """An RGB PNG of row-major BGR bytes, unfiltered."""
    rgb = np.frombuffer(bgr, np.uint8).reshape(height, width, 3)[:, :, ::-1]
    raw = np.concatenate((np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)), axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def located(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(pattern: str) -> list[str]:
    """The files that a path, or a pattern in its last part, names; in order, as paths or URIs like the pattern."""
    from pyarrow import fs

    folder, _, last = pattern.rpartition("/")
    files, base = located(folder or ".")
    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f"{folder or '.'}/{i.base_name}" for i in found if i.is_file and fnmatch.fnmatchcase(i.base_name, last))


def opened(path: str) -> BinaryIO:
    files, inner = located(path)
    return files.open_input_stream(inner, compression=None)


class _Image(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Image]:
        return [_Image(p) for p in listed(self.options["path"])]

    def read(self, partition: _Image) -> Iterator[tuple]:
        rows = int(self.options.get("rows", 256))
        with opened(partition.path) as file:
            h = header(file.read(33))
        with opened(partition.path) as file:
            for y0, n, bgr in bands(file, rows):
                yield partition.path, y0 // rows, y0, h["width"], n, bgr


class PngBands(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png_bands"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PngBands)
