"""Raster pyramids: level-by-level reduction, tile cutting, index and lookup."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.geometry import ceil_div, floor_div, level_dim, n_levels_expr, tile_extent


def levels(images: DataFrame, tile: int = 256) -> DataFrame:
    """One row a level for images (img, width, height): dims, columns, rows, tiles."""
    n = images.withColumn("n", n_levels_expr("width", "height", tile))
    z = n.select("img", "width", "height", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("z"))
    out = z.select("img", "z", "n", level_dim("width", "z", F.col("n") - 1).alias("w"), level_dim("height", "z", F.col("n") - 1).alias("h"))
    return out.withColumn("cols", ceil_div("w", tile)).withColumn("rows", ceil_div("h", tile)).withColumn("tiles", F.col("cols") * F.col("rows"))


def reduce_level(pixels: DataFrame, channels: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """The next coarser level: half-up mean of each 2x2 block.

    An odd edge replicates its last row or column, which weighs the block's pixels as their plain mean does.
    """
    mean = [F.floor((2 * F.sum(c) + F.count("*")) / (2 * F.count("*"))).cast("int").alias(c) for c in channels]
    return pixels.groupBy(*keys, floor_div("x", 2).alias("x"), floor_div("y", 2).alias("y")).agg(*mean)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of binaries or of arrays of 0 to 255, one after another."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        _, ends, data = column.buffers()
        return np.frombuffer(data or b"", np.uint8), np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset)
    values = column.values.to_numpy(zero_copy_only=False)
    if len(values) and not (values.min() >= 0 and values.max() <= 255):
        raise ValueError("a channel is not within 0 to 255")
    return values.astype(np.uint8), column.offsets.to_numpy(zero_copy_only=False)


def _deal(edge: int, channels: int, mark: bool, schema: pa.Schema):
    """Bands to pieces that lie in one block each; bands that follow one another in a batch are dealt as one.

    ``mark`` adds a channel of ones, which tells pixels from holes.
    """

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            img, z = batch["img"].to_pylist(), batch["z"].to_numpy()
            x0, y0, width = (batch[c].to_numpy() for c in ("x0", "y0", "width"))
            values, ends = _bytes(batch["data"])
            rows = np.diff(ends) // (width * channels)
            if (rows * width * channels != np.diff(ends)).any():
                raise ValueError("a band is not made of whole rows")
            new = [True] + [img[i] != img[i - 1] for i in range(1, len(img))]
            new = np.array(new) | np.r_[True, (z[1:] != z[:-1]) | (x0[1:] != x0[:-1]) | (width[1:] != width[:-1]) | (y0[1:] != y0[:-1] + rows[:-1])]
            first = np.flatnonzero(new)
            out = []
            for i, j in zip(first, np.r_[first[1:], len(img)]):
                w, left, top = int(width[i]), int(x0[i]), int(y0[i])
                area = values[ends[i] : ends[j]].reshape(-1, w, channels)
                area = np.concatenate((area, np.ones((*area.shape[:2], 1), np.uint8)), axis=2) if mark else area
                for by in range(top // edge, -(-(top + len(area)) // edge)):
                    y = max(top, by * edge)
                    for bx in range(left // edge, -(-(left + w) // edge)):
                        x = max(left, bx * edge)
                        piece = area[y - top : (by + 1) * edge - top, x - left : (bx + 1) * edge - left]
                        out.append({"img": img[i], "z": int(z[i]), "bx": bx, "by": by, "x0": x, "y0": y, "width": piece.shape[1], "data": piece.tobytes()})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    return deal


def halve(a: np.ndarray) -> np.ndarray:
    """The next coarser level of (rows, columns, channels): half-up mean of 2x2 blocks, an odd edge repeated."""
    a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2), (0, 0)), "edge").astype(np.uint16)
    return ((a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2] + 2) >> 2).astype(np.uint8)


def halve_present(a: np.ndarray) -> np.ndarray:
    """The same where the last channel is 1 for pixels and 0 for holes: the half-up mean of the pixels that are there."""
    a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2), (0, 0))).astype(np.uint16)
    a[..., :-1] *= a[..., -1:]
    total = a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]
    n = total[..., -1:]
    return np.concatenate(((2 * total[..., :-1] + n) // np.maximum(2 * n, 1), n > 0), axis=2).astype(np.uint8)


def _reduce(edge: int, tile: int, steps: int, channels: int, repeat: bool, holes: bool, schema: pa.Schema):
    """A block's pieces to its tiles at its own level (not where ``repeat``) and the next ``steps`` coarser ones."""

    def reduce(key, pieces):
        img, z, bx, by = (k.as_py() for k in key)
        x0, y0, width = (pieces[c].to_numpy() for c in ("x0", "y0", "width"))
        data = [np.frombuffer(d.as_buffer(), np.uint8).reshape(-1, w, channels) for d, w in zip(pieces["data"], width)]
        at = [(int(y) - by * edge, int(x) - bx * edge) for y, x in zip(y0, x0)]
        shape = max(y + len(d) for (y, _), d in zip(at, data)), max(x + d.shape[1] for (_, x), d in zip(at, data)), channels
        area = (np.zeros if holes else np.empty)(shape, np.uint8)
        if not holes and sum(d.size for d in data) != area.size:
            raise ValueError(f"image {img}: pixels of block ({bx}, {by}) are missing or repeated at level {z}")
        for (y, x), d in zip(at, data):
            there = area[y : y + len(d), x : x + d.shape[1]]
            if holes and (there[..., -1] & d[..., -1]).any():
                raise ValueError(f"image {img}: pixels of block ({bx}, {by}) are repeated at level {z}")
            there[...] = np.where(d[..., -1:], d, there) if holes else d
        out = []
        for k in range(min(steps, z) + 1):
            if k:
                area = halve_present(area) if holes else halve(area)
            if k or not repeat:
                per = (edge >> k) // tile
                for ty in range(-(-len(area) // tile)):
                    for tx in range(-(-area.shape[1] // tile)):
                        t = area[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
                        if holes and not t[..., -1].any():
                            continue
                        out.append({"img": img, "z": z - k, "tx": bx * per + tx, "ty": by * per + ty, "w": t.shape[1], "h": len(t), "seam": k == steps and z > k, "data": t.tobytes()})
        return pa.Table.from_pylist(out, schema)

    return reduce


def build(bands: DataFrame, levels: int, channels: int = 3, tile: int = 256, block: int = 2048, cut=None, holes: bool = False) -> DataFrame:
    """Tiles (img, z, tx, ty, w, h, data) of every level of the images whose bands are given.

    ``bands`` has (img, n, x0, y0, width, data): the image's number of levels (at most ``levels``), and whole rows of
    ``width`` pixels from (x0, y0) on, as row-major interleaved bytes or an array of them. Bands may cover any part of
    an image, but every pixel once; null data are left out, and a block with a hole raises. Rounding happens at every
    level, so each comes from the one below it: pixels are shuffled once to square blocks of up to ``block`` pixels a
    side, which hold whole sub-trees, and a block makes all its levels down to one tile. Only where an image has
    more levels are these last tiles (1 / 4^k of the pixels) shuffled again; ``cut`` (a function of a DataFrame, such as
    a written table) then keeps the blocks from being read twice.

    With ``holes``, pixels may be missing: coarser ones are means of those that are there, tiles without any are left
    out, and ``data`` has one more channel, 1 for pixels and 0 for holes. A repeated pixel still raises.
    """
    steps = max(0, (block // tile).bit_length() - 1)
    if steps == 0 and levels > 1:
        raise ValueError("a block must hold two tiles a side")
    edge, kind = tile << steps, bands.schema["img"].dataType
    head = [T.StructField("img", kind), T.StructField("z", T.IntegerType())]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    pieces = T.StructType([*head, *longs("bx", "by", "x0", "y0", "width"), T.StructField("data", T.BinaryType())])
    tiles = T.StructType([*head, *longs("tx", "ty", "w", "h"), T.StructField("seam", T.BooleanType()), T.StructField("data", T.BinaryType())])
    place = [F.col(c).cast("long").alias(c) for c in ("x0", "y0", "width")]
    rows, out = bands.where("data is not null and width > 0").select("img", (F.col("n") - 1).cast("int").alias("z"), *place, "data"), None
    for top in range(0, max(levels - 1, 1), steps or 1):
        dealt = rows.mapInArrow(_deal(edge, channels + (holes and top > 0), holes and top == 0, to_arrow_schema(pieces)), pieces)
        made = dealt.groupBy("img", "z", "bx", "by").applyInArrow(_reduce(edge, tile, steps, channels + holes, top > 0, holes, to_arrow_schema(tiles)), tiles)
        if top + steps < levels - 1:
            made = cut(made) if cut else made
            rows = made.where("seam").select("img", "z", (F.col("tx") * tile).alias("x0"), (F.col("ty") * tile).alias("y0"), F.col("w").alias("width"), "data")
        out = made if out is None else out.unionByName(made)
    return out.drop("seam")


def _by_tile(tiles: DataFrame, channels: int, schema: T.StructType, of) -> DataFrame:
    """``of(row, pixels)`` gives the columns that follow each tile's key, as arrays or single values."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch["data"]):
                row = {c: batch[c][i].as_py() for c in batch.schema.names if c != "data"}
                cols = of(row, np.frombuffer(data.as_buffer(), np.uint8).reshape(row["h"], row["w"], channels))
                n = max((len(c) for c in cols.values() if isinstance(c, np.ndarray)), default=1)
                columns = [pa.array(cols[f.name] if isinstance(cols.get(f.name), np.ndarray) else [cols.get(f.name, row.get(f.name))] * n, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return tiles.mapInArrow(run, schema)


def _inside(p: np.ndarray, holes: bool) -> np.ndarray:
    return p[..., -1] > 0 if holes else np.ones(p.shape[:2], bool)


def tile_stats(tiles: DataFrame, channel: int = 0, channels: int = 1, holes: bool = False) -> DataFrame:
    """Per tile (img, z, tx, ty, w, h): pixels, and sum, least and greatest value of one channel.

    With ``holes``, of the pixels that are there; w and h are then those of the least box around them.
    """
    keys = [f for f in tiles.schema.fields if f.name != "data"]
    schema = T.StructType([*keys, T.StructField("n", T.LongType()), T.StructField("total", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])

    def of(row, p):
        m = _inside(p, holes)
        y, x = (np.flatnonzero(m.any(axis=k)) for k in (1, 0))
        v = p[..., channel][m]
        return {"w": int(x[-1] - x[0] + 1), "h": int(y[-1] - y[0] + 1), "n": len(v), "total": int(v.sum(dtype=np.int64)), "low": int(v.min()), "high": int(v.max())}

    return _by_tile(tiles, channels + holes, schema, of)


def pixels_of(tiles: DataFrame, channels: list[str], tile: int = 256, holes: bool = False) -> DataFrame:
    """Tiles as one row a pixel: (img, z, x, y, channels)."""
    schema = T.StructType([tiles.schema["img"], tiles.schema["z"], T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in channels]])

    def of(row, p):
        y, x = np.nonzero(_inside(p, holes))
        return {"x": x + row["tx"] * tile, "y": y + row["ty"] * tile} | {c: p[y, x, i].astype(np.int32) for i, c in enumerate(channels)}

    return _by_tile(tiles, len(channels) + holes, schema, of)


def present(tiles: DataFrame, channels: int) -> DataFrame:
    """Tiles made with holes, ``data`` being the bytes of the pixels that are there, row by row."""
    return _by_tile(tiles, channels + 1, tiles.schema, lambda row, p: {"data": p[_inside(p, True)][:, :-1].tobytes()})


def index(tiles: DataFrame, cols: int, keys: tuple[str, ...] = ("img", "z")) -> DataFrame:
    """Running offsets in row-major order of each image's level for tiles (img, z, x, y, length)."""
    w = Window.partitionBy(*keys).orderBy("y", "x")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return tiles.withColumn("offset", before).withColumn("slot", (F.col("y") * cols + F.col("x")).cast("long"))


def dense_index(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Every slot of the grid (z, x, y); length 0 where no tile was written."""
    return grid.join(tiles, ["z", "x", "y"], "left").withColumn("length", F.coalesce("length", F.lit(0)).cast("long")).withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))


def lookup(requests: DataFrame, idx: DataFrame) -> DataFrame:
    return requests.join(idx, ["z", "x", "y"], "left")


def children(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Children (z + 1, 2x + i, 2y + j) that exist in the grid (z, cols, rows)."""
    two = F.sequence(F.lit(0), F.lit(1))
    c = tiles.select(F.col("z").alias("pz"), F.col("x").alias("px"), F.col("y").alias("py"), F.explode(two).alias("i"), "z", "x", "y").select("pz", "px", "py", "z", "x", "y", "i", F.explode(two).alias("j"))
    c = c.select("pz", "px", "py", (F.col("z") + 1).alias("z"), (2 * F.col("x") + F.col("i")).alias("x"), (2 * F.col("y") + F.col("j")).alias("y"))
    return c.join(grid, "z").where("x < cols and y < rows").drop("cols", "rows")


def extents(tiles: DataFrame, tile: int) -> DataFrame:
    return tiles.withColumn("tw", tile_extent("w", "x", tile)).withColumn("th", tile_extent("h", "y", tile))


def differing(a: DataFrame, b: DataFrame, channels: list[str]) -> DataFrame:
    """Pixels of two rasters that differ in any colour channel, by level."""
    r = b.select("z", "x", "y", *[F.col(c).alias(f"_{c}") for c in channels])
    bad = F.lit(False)
    for c in channels:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(r, ["z", "x", "y"], "full_outer").groupBy("z").agg(F.count_if(bad).alias("differing"))
