"""Pyramid and viewport geometry as Spark expressions (levels: 0 is the coarsest)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 256


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def floor_div(a, b) -> Column:
    """Integer division towards minus infinity; Spark's ``div`` truncates towards zero."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a, b) -> Column:
    return -floor_div(-col(a).cast("long"), b)


def clamp(v, low, high) -> Column:
    return F.greatest(col(low), F.least(col(high), col(v)))


def n_levels(width: int, height: int, tile: int = TILE) -> int:
    """Halvings, rounded up, of the longer side until it fits one tile, plus one."""
    m, n = max(width, height), 1
    while m > tile:
        m, n = (m + 1) // 2, n + 1
    return n


def n_levels_expr(width, height, tile=TILE) -> Column:
    """The same as an expression: the least n with ceil(m / 2^n) <= tile, plus one."""
    m = F.greatest(col(width), col(height)).cast("long")
    fits = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda n: ceil_div(m, F.pow(F.lit(2), n).cast("long")) <= col(tile))
    return (F.array_min(fits) + 1).cast("int")


def level_dim(full, z, z_max) -> Column:
    return ceil_div(full, F.pow(F.lit(2), col(z_max) - col(z)).cast("long"))


def tile_extent(level_size, x, tile=TILE) -> Column:
    return F.least(col(tile).cast("long"), col(level_size) - col(x) * col(tile))


def tile_key(z, x, y) -> Column:
    return F.shiftleft(col(z).cast("long"), 56).bitwiseOR(F.shiftleft(col(x).cast("long"), 28)).bitwiseOR(col(y).cast("long"))


def tile_exists(z, x, y, cols, rows, levels) -> Column:
    return col(z).between(0, col(levels) - 1) & col(x).between(0, col(cols) - 1) & col(y).between(0, col(rows) - 1)


def ancestor(v, k: int) -> Column:
    return F.shiftright(col(v), k)


def distance(x, y, vx, vy, vw, vh, tile=TILE) -> Column:
    """Tile centre to view centre, in tiles."""
    dx = (col(x) + F.lit(0.5)) * tile - (col(vx) + col(vw) / F.lit(2.0))
    dy = (col(y) + F.lit(0.5)) * tile - (col(vy) + col(vh) / F.lit(2.0))
    return F.sqrt(dx * dx + dy * dy) / tile


def half_up(v) -> Column:
    return F.floor(col(v) + F.lit(0.5)).cast("long")


def zoom_level(zoom, z_max) -> Column:
    return clamp(col(z_max) + half_up(F.log2(col(zoom))), 0, z_max).cast("int")


def zoom_clamp(zoom, w, h, full_w, full_h) -> Column:
    return clamp(zoom, F.least(col(w) / col(full_w), col(h) / col(full_h)) / 2, F.lit(16.0))


def screen_view(cx, cy, zoom, w, h, z, z_max) -> tuple[Column, Column, Column, Column]:
    """(X, Y, VW, VH) sent for a camera: level pixels, rounded, the extent at most 4096."""
    d = F.pow(F.lit(2.0), col(z_max) - col(z))
    x = (col(cx) - col(w) / (2 * col(zoom))) / d
    y = (col(cy) - col(h) / (2 * col(zoom))) / d
    vw, vh = col(w) / (col(zoom) * d), col(h) / (col(zoom) * d)
    return half_up(x), half_up(y), F.least(F.lit(4096), F.ceil(vw)).cast("long"), F.least(F.lit(4096), F.ceil(vh)).cast("long")


def pixel_under(cx, cy, zoom, w, h, px, py, full_w, full_h) -> tuple[Column, Column]:
    x = F.floor(col(cx) + (col(px) - col(w) / 2) / col(zoom))
    y = F.floor(col(cy) + (col(py) - col(h) / 2) / col(zoom))
    inside = x.between(0, col(full_w) - 1) & y.between(0, col(full_h) - 1)
    return F.when(inside, x).cast("long"), F.when(inside, y).cast("long")


def ancestor_rect(x, y, k: int, tile=TILE) -> tuple[Column, Column, Column]:
    """Left, top and side, in an ancestor k levels up, of the square that covers a tile."""
    side = F.lit(float(tile)) / (1 << k)
    return (col(x) % (1 << k)) * side, (col(y) % (1 << k)) * side, side


def deadline(t0, dist) -> Column:
    """Nanoseconds: 30 ms after the view, and 25 ms for each tile of distance."""
    return (col(t0) + F.lit(30_000_000) + half_up(F.lit(25e6) * col(dist))).cast("long")


def paeth(a, b, c) -> Column:
    a, b, c = col(a), col(b), col(c)
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)
