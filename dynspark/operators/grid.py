"""Sets of boxes: uniform grids, subdivision, selection, union of grids of mixed depth, lattices."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.functions.boxes import Domain
from dynspark.functions.keys import DEEPEST, coordinates, halvings, key_of, left_aligned
from dynspark.plans.cutting import cut


def uniform(spark: SparkSession, depth: int) -> DataFrame:
    """key of all boxes at a depth."""
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"depth must be 0 to {DEEPEST}")
    return spark.range(1 << depth).select(F.col("id").alias("key"))


def subdivide(boxes: DataFrame, times: int = 1, key: str = "key") -> DataFrame:
    """Each box becomes its 2^times parts; other columns stay."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << times) - 1).cast("long")))
    return boxes.withColumn("__part", part).withColumn(key, F.shiftleft(F.col(key), times) + F.col("__part")).drop("__part")


def subgrid(boxes: DataFrame, chosen: DataFrame, on: list[str] | None = None) -> DataFrame:
    return boxes.join(chosen, on or ["key"], "left_semi")


class Sweep:
    """Boxes (depth, key) in the order of a walk of their tree, in which the boxes below a box follow it at once.

    They are dealt to partitions by ranges of left-aligned keys, once; windows work inside these, and what goes from one
    partition to others - the first key of a later one, the furthest end of an earlier one - is a row a partition, which the driver
    passes on. first: columns that come before in the order, such as a chart.
    """

    def __init__(self, boxes: DataFrame, first: list[str] | None = None):
        at = left_aligned(F.col("key"), F.col("depth"))
        boxes = boxes.withColumns({"__at": at, "__end": at + F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(DEEPEST) - F.col("depth")).cast("int"))})
        order = [*(first or []), "__at"]
        self.rows = cut(boxes.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
        self.order = [*order, "depth"]

    def window(self, *more: str) -> Window:
        return Window.partitionBy("__part").orderBy(*self.order, *more)

    def per_part(self, agg: Column) -> dict[int, int]:
        """agg of each partition, in order; partitions where it is null are left out."""
        found = self.rows.groupBy("__part").agg(agg.alias("x")).collect()
        return {r["__part"]: r["x"] for r in sorted(found) if r["x"] is not None}

    @staticmethod
    def known(values: dict[int, int]) -> Column:
        """values of the row's partition; null where there is none."""
        return F.create_map(*[F.lit(x).cast("long") for kv in values.items() for x in kv])[F.col("__part").cast("long")] if values else F.lit(None).cast("long")


def _following(values: dict[int, int], parts: list[int]) -> dict[int, int]:
    """For each of parts the first value of a later one."""
    out, ahead = {}, None
    for p in sorted(parts, reverse=True):
        if ahead is not None:
            out[p] = ahead
        ahead = values.get(p, ahead)
    return out


def _preceding(values: dict[int, int], parts: list[int]) -> dict[int, int]:
    """For each of parts the largest value of earlier ones."""
    out, most = {}, None
    for p in sorted(parts):
        if most is not None:
            out[p] = most
        most = max(x for x in (most, values.get(p)) if x is not None) if p in values or most is not None else None
    return out


def _leaves(*grids: DataFrame) -> tuple[Sweep, DataFrame]:
    sweep = Sweep(reduce(DataFrame.unionByName, [g.select(F.col("depth").cast("int").alias("depth"), "key") for g in grids]))
    heads = sweep.per_part(F.min("__at"))
    after = F.coalesce(F.lead("__at").over(sweep.window()), sweep.known(_following(heads, list(heads))))
    return sweep, sweep.rows.withColumn("__after", after).filter(F.col("__after").isNull() | (F.col("__after") >= F.col("__end")))


def join_grids(*grids: DataFrame) -> DataFrame:
    """depth, key of the leaves of the least tree that has all grids (depth, key): a leaf with deeper ones below it goes, and
    so do repeats. In the order of the walk that is a box before whose end the next one begins."""
    return _leaves(*grids)[1].select("depth", "key")


def joined_and_ranked(*grids: DataFrame) -> DataFrame:
    """The same with ge, as ranked() gives it, by the same sort."""
    sweep, leaves = _leaves(*grids)
    return _numbered(cut(leaves.withColumn("__n", F.row_number().over(sweep.window())))).select("depth", "key", "ge")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with ge from __part and the place __n in it."""
    counts = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    return rows.withColumn("ge", F.coalesce(Sweep.known(before), F.lit(0)) + F.col("__n") - 1)


def subset(grid: DataFrame, other: DataFrame) -> DataFrame:
    """The boxes of grid (depth, key and more) that lie inside a box of other or contain one, by one sort of both: in the order of the walk a box lies
    inside one of other if the furthest end of those so far is after it, and contains one if the next of those begins before its end."""
    tagged = lambda df, row, mine: df.select(F.col("depth").cast("int").alias("depth"), "key", row.alias("__row"), F.lit(mine).alias("__mine"))
    kind = grid.select(F.struct("*").alias("x")).schema["x"].dataType
    sweep = Sweep(tagged(grid, F.struct("*"), 1).unionByName(tagged(other, F.lit(None).cast(kind), 0)))
    theirs = lambda c: F.when(F.col("__mine") == 0, F.col(c))
    ends, heads, parts = sweep.per_part(F.max(theirs("__end"))), sweep.per_part(F.min(theirs("__at"))), list(sweep.per_part(F.count(F.lit(1))))
    w = sweep.window("__mine")
    rows = sweep.rows.withColumn("__head", theirs("__at"))
    order = ", ".join([*sweep.order, "__mine"])
    rows = rows.withColumns({
        "__far": F.greatest(F.max(theirs("__end")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), sweep.known(_preceding(ends, parts))),
        "__near": F.coalesce(F.expr(f"lead(__head) IGNORE NULLS OVER (PARTITION BY __part ORDER BY {order})"), sweep.known(_following(heads, parts))),
    })
    found = rows.filter((F.col("__mine") == 1) & ((F.col("__far") > F.col("__at")) | (F.col("__near") < F.col("__end"))))
    return found.select("__row.*")


def ranked(grid: DataFrame, first: list[str] | None = None) -> DataFrame:
    """grid (depth, key) with ge, the rank of each leaf in a walk of the tree; first: columns to order by before, such as a
    chart. Ranks come from a range sort and a count for each of its partitions, so no task sees all leaves."""
    sweep = Sweep(grid, first)
    rows = cut(sweep.rows.withColumn("__n", F.row_number().over(sweep.window())))
    return _numbered(rows).select(*grid.columns, "ge")


def cubes(boxes: DataFrame, depth: int, at: int, dim: int, key: str = "key") -> DataFrame:
    """Boxes at depth as integer cubes c0 ... at another depth: cut off if that is coarser, all parts if it is finer."""
    moved = boxes.withColumn(key, F.shiftright(key, depth - at)).distinct() if at <= depth else subdivide(boxes, at - depth, key)
    return moved.withColumns({f"c{d}": c for d, c in enumerate(coordinates(F.col(key), at, dim))})


# --- lattices (row-major, axis 0 fastest) -----------------------------------------------------------------------------


def lattice(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """id, c0, c1 ... of all cells."""
    total = reduce(int.__mul__, sizes, 1)
    rest, coords = F.col("id"), {}
    for d, n in enumerate(sizes):
        coords[f"c{d}"] = F.pmod(rest, F.lit(n))
        rest = F.floor(rest / n)
    return spark.range(total).withColumns(coords)


def lattice_id(coords: list[Column], sizes: list[int]) -> Column:
    out, step = F.lit(0).cast("long"), 1
    for c, n in zip(coords, sizes, strict=True):
        out, step = out + c * step, step * n
    return out


def lattice_rects(cells: DataFrame, sizes: list[int], domain: Domain) -> DataFrame:
    ends = {}
    for d, n in enumerate(sizes):
        c, (a, b) = F.col(f"c{d}").cast("double"), (domain.lo[d], domain.hi[d])
        ends[f"l{d}"], ends[f"u{d}"] = a + c / n * (b - a), a + (c + 1.0) / n * (b - a)
    return cells.withColumns(ends)


def lattice_cover(rects: DataFrame, sizes: list[int], domain: Domain, name: str = "id") -> DataFrame:
    """rects (l0, u0 ...) with the cells that they meet or touch, one row each; rectangles outside have none."""
    out = rects
    for d, n in enumerate(sizes):
        scale = lambda x: F.lit(float(n)) * (F.col(x) - domain.lo[d]) / (domain.hi[d] - domain.lo[d])  # noqa: B023, E731
        out = out.withColumn(f"__a{d}", F.greatest(F.ceil(scale(f"l{d}") - 1.0), F.lit(0))).withColumn(f"__b{d}", F.least(F.floor(scale(f"u{d}") + 1.0), F.lit(n)) - 1)
    every = range(len(sizes))
    out = out.filter(reduce(Column.__and__, [F.col(f"__a{d}") <= F.col(f"__b{d}") for d in every]))
    for d in every:
        out = out.withColumn(f"__c{d}", F.explode(F.sequence(f"__a{d}", f"__b{d}")))
    out = out.withColumn(name, lattice_id([F.col(f"__c{d}") for d in every], sizes))
    return out.drop(*[f"__{x}{d}" for d in every for x in "abc"])


def lattice_search(points: DataFrame, sizes: list[int], domain: Domain, name: str = "id") -> DataFrame:
    """points (x0 ...) with the cell that each lies in; points outside have none. The upper ends belong to the last cells."""
    inside = reduce(Column.__and__, [(F.col(f"x{d}") >= domain.lo[d]) & (F.col(f"x{d}") <= domain.hi[d]) for d in range(len(sizes))])
    at = [F.least(F.floor((F.col(f"x{d}") - domain.lo[d]) / domain.widths()[d] * float(n)), F.lit(n - 1)) for d, n in enumerate(sizes)]
    return points.filter(inside).withColumn(name, lattice_id(at, sizes))


def lattice_edges(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """The 1-cells between neighbouring nodes of a lattice with so many cells along each axis: axis, c0, c1 ... of the lower end."""
    parts = []
    for axis in range(len(sizes)):
        nodes = [n if d == axis else n + 1 for d, n in enumerate(sizes)]
        parts.append(lattice(spark, nodes).drop("id").withColumn("axis", F.lit(axis)))
    return reduce(DataFrame.unionByName, parts)


def edges_of(cells: DataFrame, dim: int) -> DataFrame:
    """axis, c0, c1 ... (of the lower end) of the edges of cells c0, c1 ..., each once."""
    corners = [c for c in product((0, 1), repeat=dim)]
    ends = [F.struct(F.lit(axis).alias("axis"), *[(F.col(f"c{d}") + c[d]).alias(f"c{d}") for d in range(dim)]) for axis in range(dim) for c in corners if not c[axis]]
    return cells.select(F.explode(F.array(*ends)).alias("e")).select("e.*").distinct()


def _edge_starts(sizes: list[int]) -> tuple[list[list[int]], list[int]]:
    """Of the edges along each axis: how many there are along all axes, and the number of the first one."""
    shapes = [[n if d == axis else n + 1 for d, n in enumerate(sizes)] for axis in range(len(sizes))]
    counts = [reduce(int.__mul__, shape, 1) for shape in shapes]
    return shapes, [sum(counts[:axis]) for axis in range(len(sizes))]


def edge_id(sizes: list[int], axis: str = "axis") -> Column:
    """The number of the edge (axis, c0 ...): all edges along axis 0 come first, axis 0 fastest. Null for an edge that isn't in the lattice."""
    shapes, starts = _edge_starts(sizes)
    out = F.lit(None).cast("long")
    for k, (shape, start) in enumerate(zip(shapes, starts, strict=True)):
        inside = reduce(Column.__and__, [F.col(f"c{d}").between(0, n - 1) for d, n in enumerate(shape)])
        out = F.when((F.col(axis) == k) & inside, lattice_id([F.col(f"c{d}") for d in range(len(sizes))], shape) + start).otherwise(out)
    return out


def edge_place(sizes: list[int], name: str = "id") -> dict[str, Column]:
    """axis, c0, c1 ... of the edge of a number."""
    shapes, starts = _edge_starts(sizes)
    last = len(sizes) - 1
    pick = lambda xs: reduce(lambda out, k: F.when(F.col(name) >= starts[k], xs[k]).otherwise(out), range(1, last + 1), xs[0])
    places = []
    for shape, start in zip(shapes, starts, strict=True):
        rest, own = F.col(name) - start, []
        for n in shape:
            own.append(F.pmod(rest, F.lit(n)))
            rest = F.floor(rest / n)
        places.append(own)
    return {"axis": pick([F.lit(k) for k in range(last + 1)])} | {f"c{d}": pick([p[d] for p in places]).cast("long") for d in range(last + 1)}


def edge_rects(edges: DataFrame, sizes: list[int], domain: Domain) -> DataFrame:
    """edges (axis, c0 ...) with l0, u0 ...: flat but for the axis."""
    ends = {}
    for d, n in enumerate(sizes):
        c, (a, b) = F.col(f"c{d}").cast("double"), (domain.lo[d], domain.hi[d])
        ends[f"l{d}"] = a + c / n * (b - a)
        ends[f"u{d}"] = F.when(F.col("axis") == d, a + (c + 1.0) / n * (b - a)).otherwise(ends[f"l{d}"])
    return edges.withColumns(ends)


def edge_cover(rects: DataFrame, sizes: list[int], domain: Domain) -> DataFrame:
    """rects (l0, u0 ...) with axis, c0, c1 ... of the lattice's edges that they meet or touch: of a node before the rectangle along one axis the
    edge along that axis alone, of one before it along several none, of all others every edge."""
    dim = len(sizes)
    out, kept = rects, rects.columns
    for d, n in enumerate(sizes):
        scale = lambda x: F.lit(float(n)) * (F.col(x) - domain.lo[d]) / (domain.hi[d] - domain.lo[d])  # noqa: B023, E731
        out = out.withColumns({f"__a{d}": F.ceil(scale(f"l{d}") - 1.0), f"__b{d}": F.least(F.floor(scale(f"u{d}") + 1.0), F.lit(n + 1)) - 1})
    ranges = [F.sequence(F.greatest(F.col(f"__a{d}"), F.lit(0)), F.col(f"__b{d}")) for d in range(dim)]
    out = out.filter(reduce(Column.__and__, [F.greatest(F.col(f"__a{d}"), F.lit(0)) <= F.col(f"__b{d}") for d in range(dim)]))
    for d in range(dim):
        out = out.withColumn(f"c{d}", F.explode(ranges[d]))
    before = [F.col(f"c{d}") == F.col(f"__a{d}") for d in range(dim)]  # a lower end below the lattice is no node's
    many = reduce(Column.__add__, [x.cast("int") for x in before])
    own = [F.when(((many == 0) | ((many == 1) & before[d])) & (F.col(f"c{d}") < sizes[d]), F.lit(d)) for d in range(dim)]
    return out.withColumn("axis", F.explode(F.filter(F.array(*own), lambda x: x.isNotNull()))).select(*kept, "axis", *[f"c{d}" for d in range(dim)])


def neighbours(cells: DataFrame, sizes: list[int], periodic: tuple[bool, ...] = ()) -> DataFrame:
    """cells (c0 ... and more) with n0, n1 ...: all cells of the lattice that share a point with them, themselves too."""
    out = cells
    for d, n in enumerate(sizes):
        near = F.array(*[F.col(f"c{d}") + k for k in (-1, 0, 1)])
        if periodic and periodic[d]:
            near = F.array_distinct(F.transform(near, lambda x: F.pmod(x, F.lit(n))))  # noqa: B023
        else:
            near = F.filter(near, lambda x: (x >= 0) & (x < n))  # noqa: B023
        out = out.withColumn(f"n{d}", F.explode(near))
    return out


def adjacent(spark: SparkSession, sizes: list[int], periodic: tuple[bool, ...] = ()) -> DataFrame:
    """src, dst of all cells of a lattice that share a point, each with itself too."""
    return neighbours(lattice(spark, sizes), sizes, periodic).select(F.col("id").alias("src"), lattice_id([F.col(f"n{d}") for d in range(len(sizes))], sizes).alias("dst"))


def adjacent_cells(cells: DataFrame, sizes: list[int], periodic: tuple[bool, ...] = ()) -> DataFrame:
    """The same among given cells c0, c1 ..., from their neighbours; no lattice is made."""
    every = range(len(sizes))
    ids = lambda name: lattice_id([F.col(f"{name}{d}") for d in every], sizes)
    pairs = neighbours(cells.select(*[f"c{d}" for d in every]), sizes, periodic).select(ids("c").alias("src"), ids("n").alias("dst"))
    return pairs.join(cells.select(ids("c").alias("dst")), "dst", "left_semi").select("src", "dst")


def pair_patches(cells: DataFrame, sizes: list[int], periodic: tuple[bool, ...] = ()) -> DataFrame:
    """u, v: the smallest patches of given cells c0, c1 ..., one for each two neighbours (u < v), and one (v null) for a cell without any."""
    pairs = adjacent_cells(cells, sizes, periodic)
    most = pairs.groupBy("src").agg(F.max("dst").alias("most"), F.min("dst").alias("least"))
    alone = most.filter("most = src and least = src").select(F.col("src").alias("u"), F.lit(None).cast("long").alias("v"))
    return pairs.filter("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(alone)


def patches_of(cells: DataFrame, sizes: list[int], width: int = 4) -> DataFrame:
    """patch, id of given cells c0, c1 ...: overlapping blocks of a lattice, width cells wide and a cell more on each side; every pair of neighbours is in one."""
    out, blocks, every = cells, [], range(len(sizes))
    for d, n in enumerate(sizes):
        count = -(-n // width)
        near = F.array_distinct(F.array(*[F.floor((F.col(f"c{d}") + k) / width) for k in (-1, 0, 1)]))
        out = out.withColumn(f"b{d}", F.explode(F.filter(near, lambda x: (x >= 0) & (x < count))))  # noqa: B023
        blocks.append(count)
    return out.select(lattice_id([F.col(f"b{d}") for d in every], blocks).alias("patch"), lattice_id([F.col(f"c{d}") for d in every], sizes).alias("id"))


def patches(spark: SparkSession, sizes: list[int], width: int = 4) -> DataFrame:
    """patch, id of all cells of a lattice."""
    return patches_of(lattice(spark, sizes), sizes, width)


def key_from_cube(depth: int, dim: int) -> Column:
    return key_of([F.col(f"c{d}") for d in range(dim)], depth)


def cells_per_axis(depth: int, dim: int) -> list[int]:
    return [1 << t for t in halvings(depth, dim)]
