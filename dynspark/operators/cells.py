"""Cubical cells of sets of boxes, their boundaries and chains modulo a prime, as rows.

A cell of a D-dimensional lattice has doubled coordinates e0, e1 ...: odd where it extends, even where it doesn't.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dynspark.functions.boxes import Domain
from dynspark.functions.keys import DEEPEST, coordinates, halvings
from dynspark.operators.cover import meets_prism
from dynspark.operators.grid import ranked
from dynspark.plans.cutting import cut

P = 5


def extent(dim: int) -> Column:
    return reduce(add, [F.pmod(F.col(f"e{d}"), F.lit(2)) for d in range(dim)])


def cells(cubes: DataFrame, dim: int, sizes: list[int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """All faces e0 ... of the cubes c0 ..., each once (for each value of keep). sizes wraps axes that are circles (0: not one)."""
    out = cubes
    for d in range(dim):
        out = out.withColumn(f"e{d}", F.explode(F.array(*[F.col(f"c{d}") * 2 + k for k in (0, 1, 2)])))
        if sizes and sizes[d]:
            out = out.withColumn(f"e{d}", F.pmod(f"e{d}", F.lit(2 * sizes[d])))
    return out.select(*(keep or []), *[f"e{d}" for d in range(dim)]).distinct().withColumn("dim", extent(dim))


def cover(images: DataFrame, sizes: list[int], domain: Domain, keep: list[str], cubes: DataFrame | None = None) -> DataFrame:
    """keep and the cubes c0 ... (of so many along each axis) from the floor of an image's lower end to that of its upper
    one, within the lattice; if cubes are given, only those."""
    out = images
    for d, n in enumerate(sizes):
        at = lambda x: F.floor(F.lit(float(n)) * (F.col(x) - domain.lo[d]) / (domain.hi[d] - domain.lo[d]))  # noqa: B023, E731
        a, b = F.greatest(at(f"fl{d}"), F.lit(0)), F.least(at(f"fu{d}"), F.lit(n - 1))
        out = out.withColumn(f"__r{d}", F.when(a <= b, F.sequence(a, F.greatest(a, b))))
    for d in range(len(sizes)):
        out = out.withColumn(f"c{d}", F.explode_outer(f"__r{d}")).drop(f"__r{d}")
    names = [f"c{d}" for d in range(len(sizes))]
    out = out.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in names])).select(*keep, *names)
    return out if cubes is None else out.join(cubes.select(*names), names, "left_semi").select(*keep, *names)


def boundary(chains: DataFrame, dim: int, keep: list[str] | None = None, p: int = P, sizes: list[int] | None = None) -> DataFrame:
    """chains: e0 ..., coef. The boundary, like terms together, modulo p; terms that vanish go. sizes wraps axes that are circles (0: not one): the
    far side of the last cube is the near side of the first."""
    sides, before = [], F.lit(0)
    for d in range(dim):
        odd = F.pmod(F.col(f"e{d}"), F.lit(2)) == 1
        sign = F.when(F.pmod(before, F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1))
        for step in (1, -1):
            place = [F.col(f"e{k}") + (step if k == d else 0) for k in range(dim)]
            if sizes and sizes[d]:
                place[d] = F.pmod(place[d], F.lit(2 * sizes[d]))
            sides.append(F.when(odd, F.struct(*[x.alias(f"e{k}") for k, x in enumerate(place)], (F.col("coef") * sign * step).alias("coef"))))
        before = before + F.pmod(F.col(f"e{d}"), F.lit(2))
    out = chains.select(*(keep or []), F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("s")).select(*(keep or []), "s.*")
    return combined(out, dim, keep, p)


def combined(chains: DataFrame, dim: int, keep: list[str] | None = None, p: int = P) -> DataFrame:
    out = chains.groupBy(*(keep or []), *[f"e{d}" for d in range(dim)]).agg(F.pmod(F.sum("coef"), F.lit(p)).cast("int").alias("coef"))
    return out.filter("coef != 0")


def coboundary(chains: DataFrame, all_cells: DataFrame, dim: int, p: int = P, sizes: list[int] | None = None) -> DataFrame:
    """chains on cells of all_cells: the coboundary, by a join of the cells' boundaries; sizes as in boundary()."""
    names = [f"e{d}" for d in range(dim)]
    up = all_cells.select(*[F.col(x).alias(f"up{x}") for x in names], *names).withColumn("coef", F.lit(1))
    faces = boundary(up, dim, [f"up{x}" for x in names], p, sizes).withColumnRenamed("coef", "sign")
    out = faces.join(chains, names).select(*[F.col(f"up{x}").alias(x) for x in names], (F.col("sign") * F.col("coef")).alias("coef"))
    return combined(out, dim, None, p)


def _spread(some: DataFrame, dim: int, odd: int, sizes: list[int] | None, keep: list[str]) -> DataFrame:
    """Cells e0 ... with those beside them along each axis in which e is odd (1) or even (0), each once."""
    out = some
    for d in range(dim):
        e = F.col(f"e{d}")
        beside = F.array(e - 1, e, e + 1)
        if sizes and sizes[d]:
            beside = F.transform(beside, lambda x: F.pmod(x, F.lit(2 * sizes[d])))  # noqa: B023
        out = out.withColumn(f"e{d}", F.explode(F.when(F.pmod(e, F.lit(2)) == odd, beside).otherwise(F.array(e))))
    return out.select(*keep, *[f"e{d}" for d in range(dim)]).distinct().withColumn("dim", extent(dim))


def closure(some: DataFrame, dim: int, sizes: list[int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The faces of cells of any dimension, themselves too, each once (for each value of keep); sizes as in boundary()."""
    return _spread(some, dim, 1, sizes, keep or [])


def star(some: DataFrame, all_cells: DataFrame, dim: int, sizes: list[int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The cells of all_cells that have one of some as a face, those of some that are in it too; a cell has 3^dim of them at most, which are made and looked up."""
    return _spread(some, dim, 0, sizes, keep or []).join(all_cells.select(*[f"e{d}" for d in range(dim)]), [f"e{d}" for d in range(dim)], "left_semi")


def projected(chains: DataFrame, some: DataFrame, dim: int) -> DataFrame:
    """The terms of chains on the cells of a subcomplex. A chain of the subcomplex is one of the whole complex as it is; its boundary in the
    subcomplex is projected(boundary(...))."""
    return chains.join(some.select(*[f"e{d}" for d in range(dim)]), [f"e{d}" for d in range(dim)], "left_semi")


def address(sizes: list[int]) -> Column:
    """The number of a cell e0 ... of a complex with so many cubes along each axis: the place of its lower corner in a lattice with a layer more on either side,
    axis 0 fastest, then a bit for each axis in which it extends, axis 0 the lowest. An error if that takes more than 62 bits."""
    if sum((n + 2).bit_length() for n in sizes) + len(sizes) > 62:
        raise ValueError("the addresses of the complex take more than 62 bits")
    out, jump = F.lit(0).cast("long"), 1 << len(sizes)
    for d, n in enumerate(sizes):
        e = F.col(f"e{d}").cast("long")
        out, jump = out + (F.call_function("shiftright", e, F.lit(1)) + 1) * jump + F.pmod(e, F.lit(2)) * (1 << d), jump * (n + 2)
    return out


def cell_at(sizes: list[int], name: str = "address") -> dict[str, Column]:
    """e0 ... of the cell with an address."""
    out, jump = {}, 1 << len(sizes)
    for d, n in enumerate(sizes):
        place = F.pmod(F.floor(F.expr(f"{name} div {jump}")), F.lit(n + 2).cast("long")) - 1
        out[f"e{d}"], jump = place * 2 + F.call_function("shiftright", F.col(name), F.lit(d)).bitwiseAND(F.lit(1).cast("long")), jump * (n + 2)
    return out


def numbered(all_cells: DataFrame, sizes: list[int]) -> DataFrame:
    """all_cells (e0 ..., dim) with address and index, the cell's place among those of its dimension in order of addresses, by a range sort."""
    rows = ranked(all_cells.withColumn("key", address(sizes)).withColumn("depth", F.lit(DEEPEST)), ["dim"])
    first = rows.groupBy("dim").agg(F.min("ge").alias("__first"))  # a row a dimension
    rows = rows.join(F.broadcast(first), "dim").withColumn("index", F.col("ge") - F.col("__first"))
    return rows.select(*all_cells.columns, F.col("key").alias("address"), "index")


def boundary_matrix(all_cells: DataFrame, sizes: list[int], circles: tuple[bool, ...] = (), p: int = P) -> DataFrame:
    """dim, row, column, value: the entries other than zero of the boundary maps of a complex or subcomplex (e0 ..., dim); columns are the indices of
    its cells of that dimension, rows those of one less, faces that aren't cells of it are left out."""
    every = range(len(sizes))
    wraps = [n if circles and circles[d] else 0 for d, n in enumerate(sizes)]
    cells_ = cut(numbered(all_cells, sizes))
    names = [f"e{d}" for d in every]
    columns = cells_.select("dim", F.col("index").alias("column"), *names, F.lit(1).alias("coef"))
    rows = cells_.select((F.col("dim") + 1).alias("dim"), F.col("index").alias("row"), *names)
    return boundary(columns, len(sizes), ["dim", "column"], p, wraps).join(rows, ["dim", *names]).select("dim", "row", "column", F.col("coef").alias("value"))


def face_counts(all_cells: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return all_cells.groupBy(*(keep or []), "dim").agg(F.count(F.lit(1)).alias("n"))


def euler_characteristic(all_cells: DataFrame, keep: list[str] | None = None) -> DataFrame:
    sign = F.when(F.pmod("dim", F.lit(2)) == 0, 1).otherwise(-1)
    return all_cells.groupBy(*(keep or [])).agg(F.sum(sign).alias("euler"))


def relative(pair: DataFrame, dim: int, keep: list[str]) -> DataFrame:
    """pair: keep, c0 ..., exit. The cells of X that aren't cells of A (the exit boxes)."""
    inside = cells(pair, dim, keep=keep)
    exits = cells(pair.filter("exit"), dim, keep=keep)
    return inside.join(exits, [*keep, *[f"e{d}" for d in range(dim)]], "left_anti")


def relative_complex(x: DataFrame, a: DataFrame, at: int, domain: Domain, keep: list[str]) -> DataFrame:
    """x and a: keep, depth, key. The cells (keep, e0 ..., dim) of the boxes x that aren't cells of the boxes a, as cubes of the depth `at`.

    Coarser boxes become all their cubes, finer ones the cube that they are in. Coordinates count from the least cube of x (of each keep). A periodic axis
    wraps if x spans it from end to end, and only then.
    """
    dim = domain.dim
    every, total = range(dim), halvings(at, dim)
    cubes = {name: _cubes_at(df, at, dim, keep) for name, df in (("x", x), ("a", a))}
    corner = [c for d in every for c in (F.min(f"c{d}").alias(f"__min{d}"), F.max(f"c{d}").alias(f"__max{d}"))]
    spans = cubes["x"].groupBy(*keep).agg(*corner)
    whole = lambda d: (F.col(f"__min{d}") == 0) & (F.col(f"__max{d}") == (1 << total[d]) - 1) if domain.periodic[d] else F.lit(False)

    def faces(cubes: DataFrame) -> DataFrame:
        out = cubes.join(spans, keep)
        for d in every:
            out = out.withColumn(f"e{d}", F.explode(F.array(*[(F.col(f"c{d}") - F.col(f"__min{d}")) * 2 + k for k in (0, 1, 2)])))
            out = out.withColumn(f"e{d}", F.when(whole(d), F.pmod(f"e{d}", F.lit(2 << total[d]))).otherwise(F.col(f"e{d}")))
        return out.select(*keep, *[f"e{d}" for d in every]).distinct()

    return faces(cubes["x"]).join(faces(cubes["a"]), [*keep, *[f"e{d}" for d in every]], "left_anti").withColumn("dim", extent(dim))


def _cubes_at(boxes: DataFrame, at: int, dim: int, keep: list[str]) -> DataFrame:
    """keep, c0 ... of boxes (keep, depth, key) of any depths."""
    shift = lambda name, x, by: F.call_function(name, x, by.cast("int"))
    less, more = F.greatest(F.lit(at) - F.col("depth"), F.lit(0)), F.greatest(F.col("depth") - F.lit(at), F.lit(0))
    part = F.explode(F.sequence(F.lit(0).cast("long"), shift("shiftleft", F.lit(1).cast("long"), less) - 1))
    key = shift("shiftright", shift("shiftleft", F.col("key").cast("long"), less) + F.col("__part"), more)
    out = boxes.withColumn("__part", part).select(*keep, key.alias("key")).distinct()
    return out.select(*keep, *[c.alias(f"c{d}") for d, c in enumerate(coordinates(F.col("key"), at, dim))])


def geometry(all_cells: DataFrame, sizes: list[int], domain: Domain) -> DataFrame:
    """Cells e0 ... of a complex with so many cubes along each axis, with l0, u0 ...: along an axis in which a cell doesn't extend both are its place."""
    ends = {}
    for d, n in enumerate(sizes):
        step = (domain.hi[d] - domain.lo[d]) / float(n)
        ends[f"l{d}"] = domain.lo[d] + step * F.shiftright(f"e{d}", 1).cast("double")
    out = all_cells.withColumns(ends)
    return out.withColumns({f"u{d}": F.when(F.pmod(F.col(f"e{d}"), F.lit(2)) == 1, F.col(f"l{d}") + (domain.hi[d] - domain.lo[d]) / float(n)).otherwise(F.col(f"l{d}")) for d, n in enumerate(sizes)})


def prism_cover(prisms: DataFrame, sizes: list[int], domain: Domain, keep: list[str], cubes: DataFrame | None = None) -> DataFrame:
    """keep and the cubes c0 ... that a prism (a00 ..., m0 ...: {A x + m : -1 <= x <= 1}) meets or touches; if cubes are given, only those."""
    dim, names = len(sizes), [f"c{d}" for d in range(len(sizes))]
    shape = [f"a{i}{j}" for i in range(dim) for j in range(dim)] + [f"m{d}" for d in range(dim)]
    out = prisms
    for d, n in enumerate(sizes):
        reach = reduce(add, [F.abs(F.col(f"a{d}{j}")) for j in range(dim)])
        at = lambda x: F.lit(float(n)) * (x - domain.lo[d]) / (domain.hi[d] - domain.lo[d])  # noqa: B023, E731
        a, b = F.greatest(F.ceil(at(F.col(f"m{d}") - reach)) - 1, F.lit(0)), F.least(F.floor(at(F.col(f"m{d}") + reach)), F.lit(n - 1))
        out = out.withColumn(f"__r{d}", F.when(a <= b, F.sequence(a, F.greatest(a, b))))
    for d in range(dim):
        out = out.withColumn(f"c{d}", F.explode_outer(f"__r{d}")).drop(f"__r{d}")
    out = out.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in names])).select(*keep, *shape, *names)
    if cubes is not None:
        out = out.join(cubes.select(*names), names, "left_semi")
    step = [(domain.hi[d] - domain.lo[d]) / float(n) for d, n in enumerate(sizes)]
    out = out.withColumns({f"{e}{d}": domain.lo[d] + (F.col(f"c{d}") + k).cast("double") * step[d] for d in range(dim) for e, k in (("l", 0), ("u", 1))})
    return out.filter(meets_prism(dim)).select(*keep, *names)
