"""Dyadic path keys as column expressions.

A box at depth n has n path bits, root first, right aligned in a long; bit i halves axis i mod D (0: lower half). Axis d
has been halved ceil((n - d) / D) times, and its coordinate is made of its own path bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEEPEST = 62


def halvings(depth: int, dim: int) -> list[int]:
    return [max(0, -(-(depth - d) // dim)) for d in range(dim)]


def coordinate(key: Column, depth: int, dim: int, axis: int) -> Column:
    bits = [F.shiftleft(F.shiftright(key, depth - 1 - i).bitwiseAND(F.lit(1).cast("long")), halvings(depth, dim)[axis] - 1 - i // dim) for i in range(axis, depth, dim)]
    return reduce(Column.bitwiseOR, bits) if bits else F.lit(0).cast("long")


def coordinates(key: Column, depth: int, dim: int) -> list[Column]:
    return [coordinate(key, depth, dim, d) for d in range(dim)]


def key_of(coords: list[Column], depth: int) -> Column:
    dim = len(coords)
    t = halvings(depth, dim)
    one = F.lit(1).cast("long")
    bits = [F.shiftleft(F.shiftright(coords[i % dim].cast("long"), t[i % dim] - 1 - i // dim).bitwiseAND(one), depth - 1 - i) for i in range(depth)]
    return reduce(Column.bitwiseOR, bits) if bits else F.lit(0).cast("long")


def parent(key: Column, levels: int = 1) -> Column:
    return F.shiftright(key, levels)


def child(key: Column, side: int) -> Column:
    """The lower (0) or upper (1) half of a box."""
    return F.shiftleft(key, 1) + side


def is_upper(key: Column) -> Column:
    return key.bitwiseAND(F.lit(1).cast("long")) == 1


def left_aligned(key: Column, depth: Column | int) -> Column:
    """Orders boxes of mixed depth as a walk of the tree does."""
    shift = (F.lit(DEEPEST) - (F.lit(depth) if isinstance(depth, int) else depth)).cast("int")
    return F.call_function("shiftleft", key.cast("long"), shift)
