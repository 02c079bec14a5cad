"""Covers: which boxes does a rectangle meet. A range join made of integer arithmetic, explode and an equi-join.

Ends are taken to 60-bit fixed point with a slack of 2^10, and touching counts. At a uniform depth the boxes that a
rectangle meets are a product of one range of coordinates per axis.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dynspark.functions.boxes import Domain, rects_of
from dynspark.functions.keys import halvings, key_of

WIDTH, SLACK = 60, 1 << 10


def _fixed(lo: str, hi: str, low: float, high: float) -> tuple[str, str, str]:
    """Both ends in fixed point with the slack, and whether [lo, hi] meets the axis at all, in SQL."""
    a, b = (f"((`{x}` - {low!r}D) / {high - low!r}D)" for x in (lo, hi))
    fixed = lambda x: f"cast({float(1 << WIDTH)!r}D * greatest(0D, least(1D, {x})) as bigint)"
    return f"greatest({fixed(a)} - {SLACK}L, 0L)", f"least({fixed(b)} + {SLACK}L, {1 << WIDTH}L)", f"({b} >= 0D and {a} <= 1D)"


def axis_range(lo: str, hi: str, low: float, high: float, t: int) -> tuple[str, str, str]:
    """First and last coordinate among 2^t that [lo, hi] (names of columns) meets, and whether it meets the axis at all, in SQL."""
    left, right, meets = _fixed(lo, hi, low, high)
    s = WIDTH - t
    return f"greatest(shiftright({left} - 1L, {s}), 0L)", f"least(shiftright({right}, {s}), {(1 << t) - 1}L)", meets  # the first: ceil(left / 2^s) - 1


def wrapped(images: DataFrame, domain: Domain, strict: bool) -> DataFrame:
    """For periodic axes: at most one width long, moved to the domain, and a second time one width away. strict moves a
    rectangle whose end is above the domain down by one width and no more, and the second one is above the first; else
    the lower end comes to lie in the domain, and the second one is below."""
    if not any(domain.periodic):
        return images
    out = images
    for d in (d for d in range(domain.dim) if domain.periodic[d]):
        lo, hi, w = F.col(f"fl{d}"), F.col(f"fu{d}"), domain.widths()[d]
        down = F.when(hi > domain.hi[d], F.lit(w)).otherwise(F.lit(0.0)) if strict else F.floor((lo - domain.lo[d]) / w) * w
        out = out.withColumn("__down", down).withColumns({f"fl{d}": lo - F.col("__down"), f"fu{d}": hi - F.col("__down")}).drop("__down")
        out = out.withColumn(f"fu{d}", F.least(hi, lo + w))
        out = out.withColumn("__up", F.explode(F.array(F.lit(0.0), F.lit(w if strict else -w)))).withColumns({f"fl{d}": lo + F.col("__up"), f"fu{d}": hi + F.col("__up")}).drop("__up")
    return out


def cover_cells(images: DataFrame, depth: int, domain: Domain, keep: list[str], strict: bool = True) -> DataFrame:
    """The columns keep and c0, c1 ... of each box at depth that the rectangle fl0, fu0 ... meets."""
    t, dim = halvings(depth, domain.dim), domain.dim
    ranges = {}
    for d in range(dim):
        a, b, meets = axis_range(f"fl{d}", f"fu{d}", domain.lo[d], domain.hi[d], t[d])
        ranges[f"__r{d}"] = F.expr(f"case when {meets} then sequence({a}, greatest({a}, {b})) end")  # a touching rectangle has a <= b; null: outside
    out = wrapped(images, domain, strict).select(*keep, *[c.alias(name) for name, c in ranges.items()])
    for d in range(dim):  # outer: of explode() Catalyst infers a filter on the whole range, which it then moves down to the scan
        out = out.withColumn(f"c{d}", F.explode_outer(f"__r{d}")).drop(f"__r{d}")
    out = out.filter(reduce(Column.__and__, [F.col(f"c{d}").isNotNull() for d in range(dim)]))
    return out.distinct() if any(domain.periodic) else out


def cover(images: DataFrame, depth: int, domain: Domain, keep: list[str], strict: bool = True) -> DataFrame:
    """The same with dst, the key of the box."""
    out = cover_cells(images, depth, domain, keep, strict)
    return out.select(*keep, key_of([F.col(f"c{d}") for d in range(domain.dim)], depth).alias("dst"))


def tree(boxes: DataFrame, depths: list[int], dim: int) -> list[DataFrame]:
    """boxes (depth, key) of depths (ascending) as the nodes of their tree at depths[0], and from there on dim halvings deeper each time: at, key, whether it is
    a leaf, depth and key of the leaf, and the node above."""
    levels = list(range(depths[0], depths[-1], dim)) + [depths[-1]]
    out, before = [], None
    for level in levels:
        own = boxes.filter((F.col("depth") <= level) & (F.col("depth") > (before if before is not None else -1)))
        over = boxes.filter(F.col("depth") > level).select(F.call_function("shiftright", F.col("key"), F.col("depth") - level).alias("key")).distinct()
        nodes = own.select(F.col("depth").cast("int").alias("depth"), "key", F.lit(True).alias("leaf")).unionByName(over.select(F.lit(level).alias("depth"), "key", F.lit(False).alias("leaf")))
        up = F.call_function("shiftright", F.col("key"), F.col("depth") - (before if before is not None else level))
        out.append(nodes.withColumn("above", up))
        before = level
    return out


def cover_mixed(images: DataFrame, boxes: DataFrame, depths: list[int], domain: Domain, keep: list[str], strict: bool = True) -> DataFrame:
    """keep, depth, dst of the boxes (depth, key; leaves of a grid whose depths are among the ascending ones given) that a rectangle fl0, fu0 ... meets.

    A descent of the boxes' tree: from the nodes at the least depth that a rectangle meets to those of their parts that
    there are and that it meets, all axes halved once in a step, by equi-joins on the node above. Where the grid is coarse nothing is made that isn't in it.
    """
    dim = domain.dim
    nodes = tree(boxes, depths, dim)
    ends = [f"f{e}{d}" for d in range(dim) for e in "lu"]
    moved = wrapped(images, domain, strict).select(*keep, *ends)
    top = cover_cells(moved, depths[0], Domain(domain.lo, domain.hi), [*keep, *ends])
    front = top.select(*keep, *ends, key_of([F.col(f"c{d}") for d in range(dim)], depths[0]).alias("above"))
    found = []
    for level, own in enumerate(nodes):
        met = front.join(own, "above")
        if level:
            met = met.filter(reduce(Column.__and__, [_on_axis(d, depths[-1], domain) for d in range(dim)]))
        found.append(met.filter("leaf").select(*keep, "depth", F.col("key").alias("dst")))
        front = met.filter("not leaf").select(*keep, *ends, F.col("key").alias("above"))
    out = reduce(DataFrame.unionByName, found)
    return out.distinct() if any(domain.periodic) else out


def _on_axis(d: int, deepest: int, domain: Domain) -> Column:
    """The node (depth, key) is among those of its depth that the rectangle meets along axis d."""
    dim = domain.dim
    halved = f"(depth - {d} + {dim - 1}) div {dim}"  # of axis d, at the node's depth
    bit = lambda i: f"case when depth > {i} then shiftleft(shiftright(key, greatest(depth - {1 + i}, 0)) & 1L, cast({halved} - {1 + i // dim} as int)) else 0L end"
    place = " + ".join(bit(i) for i in range(d, deepest, dim)) or "0L"
    left, right, _ = _fixed(f"fl{d}", f"fu{d}", domain.lo[d], domain.hi[d])
    s = f"cast({WIDTH} - {halved} as int)"
    return F.expr(f"({place}) between shiftright({left} - 1L, {s}) and shiftright({right}, {s})")


def within(covered: DataFrame, boxes: DataFrame, on: list[str] | None = None) -> DataFrame:
    """covered (dst and on, perhaps a node) restricted to boxes (key and on)."""
    on = on or []
    return covered.join(boxes.select(*on, F.col("key").alias("dst")), [*on, "dst"], "left_semi")


def union_cover(covers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, covers).distinct()


def intersection_cover(covers: list[DataFrame]) -> DataFrame:
    """Rows that all covers have."""
    tagged = [c.distinct().withColumn("__of", F.lit(k)) for k, c in enumerate(covers)]
    return reduce(DataFrame.unionByName, tagged).groupBy(*covers[0].columns).agg(F.count("__of").alias("__n")).filter(F.col("__n") == len(covers)).drop("__n")


def _determinant(rows: list[int], columns: list[int]) -> Column:
    """Of the rows and columns of the matrix a00, a01 ... that are named, by expansion."""
    if not rows:
        return F.lit(1.0)
    terms = [F.col(f"a{rows[0]}{c}") * _determinant(rows[1:], [x for x in columns if x != c]) * (-1.0 if k % 2 else 1.0) for k, c in enumerate(columns)]
    return reduce(Column.__add__, terms)


def meets_prism(dim: int) -> Column:
    """The rectangle l0, u0 ... isn't separated from the prism a00 ..., m0 ... along a normal of the prism's faces."""
    every, tests = list(range(dim)), []
    half = F.abs(_determinant(every, every))
    for j in every:  # the normal of the faces that all columns but j span: cofactors
        normal = [_determinant([r for r in every if r != i], [c for c in every if c != j]) * (-1.0 if (i + j) % 2 else 1.0) for i in every]
        apart = reduce(Column.__add__, [n * ((F.col(f"l{d}") + F.col(f"u{d}")) / 2 - F.col(f"m{d}")) for d, n in enumerate(normal)])
        spread = reduce(Column.__add__, [F.abs(n) * (F.col(f"u{d}") - F.col(f"l{d}")) / 2 for d, n in enumerate(normal)])
        tests.append(F.abs(apart) <= half + spread + 1e-9 * (F.lit(1.0) + half))
    return reduce(Column.__and__, tests)


def prism_cover(prisms: DataFrame, depth: int, domain: Domain, keep: list[str]) -> DataFrame:
    """prisms: {A x + c : -1 <= x <= 1}, a00 ... and c0 ... Boxes that aren't separated from the prism along the axes of the
    box or the normals of the prism's faces; candidates come from the bounding rectangle. A flat prism is as good as its rectangle along what it lacks."""
    dim = domain.dim
    every = list(range(dim))
    prisms = prisms.withColumnsRenamed({f"c{d}": f"m{d}" for d in every})  # c0 ... are cells below
    reach = [reduce(Column.__add__, [F.abs(F.col(f"a{d}{j}")) for j in every]) for d in every]
    bounded = prisms.withColumns({f"fl{d}": F.col(f"m{d}") - reach[d] for d in every} | {f"fu{d}": F.col(f"m{d}") + reach[d] for d in every})
    shape = [f"a{i}{j}" for i in every for j in every] + [f"m{d}" for d in every]
    out = rects_of(cover_cells(bounded, depth, domain, [*keep, *shape]), halvings(depth, dim), domain)
    return out.filter(meets_prism(dim)).select(*keep, key_of([F.col(f"c{d}") for d in every], depth).alias("dst"))
