"""The 32-bit hash contract of the holdings filter, in LONG arithmetic that never overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geometry import col

M_BITS, K = 4096, 7
MASK = 4294967295


def bind(v: Column, f) -> Column:
    """f(v) with v evaluated once, however often f names it."""
    return F.transform(F.array(v), f)[0]


def mul32(h: Column, c: int) -> Column:
    """h * c modulo 2^32 by 16-bit halves."""
    low = h.bitwiseAND(F.lit(65535)) * F.lit(c)
    high = (F.shiftright(h, 16) * F.lit(c)).bitwiseAND(F.lit(65535)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(MASK))


def be_bytes(v: Column, n: int) -> list[Column]:
    return [F.shiftright(v.cast("long"), 8 * (n - 1 - i)).bitwiseAND(F.lit(255)) for i in range(n)]


def fnv1a(parts: list[Column]) -> Column:
    h = F.lit(2166136261)
    for b in parts:
        h = (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(MASK))  # 25-bit prime: fits a LONG
    return h


def fmix32(h: Column) -> Column:
    fold = lambda v, n: bind(v, lambda x: x.bitwiseXOR(F.shiftright(x, n)))
    times = lambda v, c: bind(v, lambda x: mul32(x, c))
    return fold(times(fold(times(fold(h, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)


def hash_pair(sem, z, x, y) -> tuple[Column, Column]:
    h1 = fnv1a(be_bytes(col(sem), 4) + be_bytes(col(z), 1) + be_bytes(col(x), 4) + be_bytes(col(y), 4))
    return h1, fmix32(h1).bitwiseOR(F.lit(1))


def positions_of(h1: Column, h2: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda i: ((h1 + i.cast("long") * h2).bitwiseAND(F.lit(MASK)) % F.lit(M_BITS)).cast("int"))


def false_positive_theory(n, m: int = M_BITS, k: int = K) -> Column:
    return F.pow(1 - F.exp(-k * col(n) / F.lit(float(m))), F.lit(float(k)))


def rotate_seed(sem) -> Column:
    return (col(sem) + 1).bitwiseAND(F.lit(MASK))
