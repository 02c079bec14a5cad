"""Interval arithmetic on pairs of columns, without outward rounding.

The logarithm is monotone at both ends, and powers of bases that straddle zero follow the even or odd case of an integer exponent.
"""

from __future__ import annotations

from math import pi
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = int | float


class Interval(NamedTuple):
    lo: Column
    hi: Column

    def mid(self) -> Column:
        return (self.lo + self.hi) / 2

    def radius(self) -> Column:
        return (self.hi - self.lo) / 2

    def __add__(self, other: Interval | Number) -> Interval:  # type: ignore[override]
        o = interval(other)
        return Interval(self.lo + o.lo, self.hi + o.hi)

    __radd__ = __add__

    def __sub__(self, other: Interval | Number) -> Interval:
        o = interval(other)
        return Interval(self.lo - o.hi, self.hi - o.lo)

    def __rsub__(self, other: Number) -> Interval:
        return interval(other) - self

    def __neg__(self) -> Interval:
        return Interval(-self.hi, -self.lo)

    def __mul__(self, other: Interval | Number) -> Interval:  # type: ignore[override]
        if isinstance(other, Interval):
            products = [a * b for a in self for b in other]
            return Interval(F.least(*products), F.greatest(*products))
        ends = (self.lo * float(other), self.hi * float(other))
        return Interval(*(ends if other >= 0 else ends[::-1]))

    __rmul__ = __mul__

    def __truediv__(self, other: Interval | Number) -> Interval:
        return self * power(interval(other), -1.0)


def interval(x: Interval | Number) -> Interval:
    return x if isinstance(x, Interval) else Interval(F.lit(float(x)), F.lit(float(x)))


def power(x: Interval, exponent: float) -> Interval:
    if exponent == 0:
        return interval(1.0)
    ends = [F.pow(x.lo, F.lit(float(exponent))), F.pow(x.hi, F.lit(float(exponent)))]
    if float(exponent).is_integer() and exponent > 0 and exponent % 2 == 0:
        inside = (x.lo <= 0) & (x.hi >= 0)
        return Interval(F.when(inside, F.lit(0.0)).otherwise(F.least(*ends)), F.greatest(*ends))
    return Interval(*(ends if exponent > 0 else ends[::-1]))


def square(x: Interval) -> Interval:
    lo, hi = x.lo * x.lo, x.hi * x.hi
    return Interval(F.when((x.lo <= 0) & (x.hi >= 0), F.lit(0.0)).otherwise(F.least(lo, hi)), F.greatest(lo, hi))


def exp(x: Interval) -> Interval:
    return Interval(F.exp(x.lo), F.exp(x.hi))


def log(x: Interval) -> Interval:
    return Interval(F.ln(x.lo), F.ln(x.hi))


def tanh(x: Interval) -> Interval:
    return Interval(F.tanh(x.lo), F.tanh(x.hi))


def _meets(x: Interval, at: float, period: float) -> Column:
    """Whether the interval has a point at + k * period."""
    return F.floor((x.hi - at) / period) >= F.ceil((x.lo - at) / period)


def cos(x: Interval) -> Interval:
    a, b = F.cos(x.lo), F.cos(x.hi)
    return Interval(F.when(_meets(x, pi, 2 * pi), F.lit(-1.0)).otherwise(F.least(a, b)), F.when(_meets(x, 0.0, 2 * pi), F.lit(1.0)).otherwise(F.greatest(a, b)))


def sin(x: Interval) -> Interval:
    return cos(x - pi / 2)


def _between_poles(x: Interval, pole: float, lo: Column, hi: Column) -> Interval:
    out = _meets(x, pole, pi)
    return Interval(F.when(out, F.lit(float("-inf"))).otherwise(lo), F.when(out, F.lit(float("inf"))).otherwise(hi))


def tan(x: Interval) -> Interval:
    return _between_poles(x, pi / 2, F.tan(x.lo), F.tan(x.hi))


def cot(x: Interval) -> Interval:
    return _between_poles(x, 0.0, F.cot(x.hi), F.cot(x.lo))
