"""Boxes and rectangles as columns: l0, u0, l1, u1 ... in the coordinates of a domain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dynspark.functions.keys import halvings


@dataclass(frozen=True)
class Domain:
    """A box in R^D, some of whose axes may be circles."""

    lo: tuple[float, ...]
    hi: tuple[float, ...]
    periodic: tuple[bool, ...] = field(default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "lo", tuple(map(float, self.lo)))
        object.__setattr__(self, "hi", tuple(map(float, self.hi)))
        object.__setattr__(self, "periodic", tuple(map(bool, self.periodic or [False] * len(self.lo))))
        if not len(self.lo) == len(self.hi) == len(self.periodic):
            raise ValueError("the bounds and the periodic flags have different lengths")
        if any(a >= b for a, b in zip(self.lo, self.hi, strict=True)):
            raise ValueError("a lower bound isn't below its upper bound")

    @property
    def dim(self) -> int:
        return len(self.lo)

    def widths(self) -> list[float]:
        return [b - a for a, b in zip(self.lo, self.hi, strict=True)]


def rect_columns(dim: int, lo: str = "l", hi: str = "u") -> list[str]:
    return [x for d in range(dim) for x in (f"{lo}{d}", f"{hi}{d}")]


def bounds(c: Column, t: int, lo: float, hi: float) -> tuple[Column, Column]:
    """Of the c-th of 2^t equal parts: convex combinations of the ends with dyadic weights, exact up to the last step."""
    cells = float(1 << t)
    left, right = c.cast("double") / cells, (F.lit(cells) - 1.0 - c.cast("double")) / cells
    return left * hi + (1.0 - left) * lo, right * lo + (1.0 - right) * hi


def rects_of(cells: DataFrame, t: list[int], domain: Domain) -> DataFrame:
    """cells (c0, c1 ... of 2^t[d] parts of each axis) with l0, u0 ..., as bounds() has them."""
    ends = {}
    for d in range(domain.dim):  # one expression each: built out of columns they would take longer than to run on few boxes
        n, lo, hi = f"{float(1 << t[d])!r}D", f"{domain.lo[d]!r}D", f"{domain.hi[d]!r}D"
        left, right = f"(cast(c{d} as double) / {n})", f"(({n} - 1D - cast(c{d} as double)) / {n})"
        ends[f"l{d}"], ends[f"u{d}"] = F.expr(f"{left} * {hi} + (1D - {left}) * {lo}"), F.expr(f"{right} * {lo} + (1D - {right}) * {hi}")
    return cells.withColumns(ends)


def with_cells(boxes: DataFrame, depth: int, dim: int, key: str = "key") -> DataFrame:
    """boxes with c0, c1 ... of their keys at depth."""
    t = halvings(depth, dim)
    bit = lambda i, d: f"shiftleft(shiftright(`{key}`, {depth - 1 - i}) & 1L, {t[d] - 1 - i // dim})"
    return boxes.withColumns({f"c{d}": F.expr(" | ".join(bit(i, d) for i in range(d, depth, dim)) or "0L") for d in range(dim)})


def with_rects(boxes: DataFrame, depth: int, domain: Domain, key: str = "key") -> DataFrame:
    """boxes with l0, u0 ... of their keys at depth."""
    out = rects_of(with_cells(boxes, depth, domain.dim, key), halvings(depth, domain.dim), domain)
    return out.drop(*[f"c{d}" for d in range(domain.dim)])


def meet(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]], slack: float = 1e-8) -> Column:
    """Closed rectangles meet, with a little slack."""
    out = F.lit(True)
    for (al, au), (bl, bu) in zip(a, b, strict=True):
        out = out & (al <= bu + slack) & (bl <= au + slack)
    return out


# --- arithmetic of rectangles -----------------------------------------------------------------------------------------


def centroid(dim: int) -> dict[str, Column]:
    """Both ends become the middle."""
    return {x: (F.col(f"l{d}") + F.col(f"u{d}")) / 2.0 for d in range(dim) for x in (f"l{d}", f"u{d}")}


def scaled(by: Column | float, dim: int) -> dict[str, Column]:
    """Each end times a number; a negative one doesn't swap ends."""
    return {x: F.col(x) * by for x in rect_columns(dim)}


def added(dim: int, lo: str = "ol", hi: str = "ou") -> dict[str, Column]:
    """End by end the sum with the rectangle in the columns lo0, hi0 ..."""
    return {x: F.col(x) + F.col(y) for x, y in zip(rect_columns(dim), rect_columns(dim, lo, hi), strict=True)}


def same_rect(dim: int, lo: str = "ol", hi: str = "ou") -> Column:
    """Equal ends in single precision, in which rectangles are compared and hashed."""
    out = F.lit(True)
    for x, y in zip(rect_columns(dim), rect_columns(dim, lo, hi), strict=True):
        out = out & (F.col(x).cast("float") == F.col(y).cast("float"))
    return out


def rect_hash(dim: int) -> Column:
    """A hash under which same_rect() rectangles agree, to join or group by."""
    return F.xxhash64(*[F.col(x).cast("float") for x in rect_columns(dim)])
