"""Arithmetic modulo a prime below 2^31, as columns of whole numbers; results are 0 ... p - 1, and null where an argument is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reduced(x: Column, p: int) -> Column:
    return F.pmod(x.cast("long"), F.lit(p).cast("long"))


def plus(x: Column, y: Column, p: int) -> Column:
    return reduced(reduced(x, p) + reduced(y, p), p)


def minus(x: Column, y: Column, p: int) -> Column:
    return reduced(reduced(x, p) - reduced(y, p), p)


def times(x: Column, y: Column, p: int) -> Column:
    return reduced(reduced(x, p) * reduced(y, p), p)


def power(x: Column, n: int, p: int) -> Column:
    """x to the n-th, n >= 0. The bits of n are walked inside one expression, so that the plan stays small."""
    bits = F.array(*[F.lit(int(b)) for b in bin(n)[2:]])
    base = reduced(x, p)
    step = lambda r, bit: times(times(r, r, p), F.when(bit == 1, base).otherwise(F.lit(1).cast("long")), p)
    return F.when(x.isNotNull(), F.aggregate(bits, F.lit(1 % p).cast("long"), step))


def inverse(x: Column, p: int) -> Column:
    """By Fermat's little theorem; null for multiples of p, which have none."""
    return F.when(reduced(x, p) != 0, power(x, p - 2, p))


def over(x: Column, y: Column, p: int) -> Column:
    return times(x, inverse(y, p), p)


def balanced(x: Column, p: int) -> Column:
    """The number between -p / 2, not included, and p / 2 that differs from x by a multiple of p."""
    r = reduced(x, p)
    return F.when(r * 2 > p, r - p).otherwise(r)
