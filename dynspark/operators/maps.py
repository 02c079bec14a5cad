"""Maps of boxes: rectangles (l0, u0 ...) get the rectangles fl0, fu0 ... that hold their images."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dynspark.functions.boxes import Domain, rect_columns
from dynspark.functions.intervals import Interval

PointMap = Callable[[list[Column]], Sequence[Column]]


def _different(xs: list[Column]) -> list[Column]:
    """Without repeats of one expression: a component often depends on some axes only."""
    return list({str(x): x for x in xs}.values())


def _least(xs: list[Column]) -> Column:
    xs = _different(xs)
    return F.least(*xs) if len(xs) > 1 else xs[0]


def _greatest(xs: list[Column]) -> Column:
    xs = _different(xs)
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def corner_points(dim: int) -> list[list[Column]]:
    return [[F.col(f"{'u' if s else 'l'}{d}") for d, s in enumerate(sides)] for sides in product((0, 1), repeat=dim)]


def center_point(dim: int) -> list[Column]:
    return [F.col(f"l{d}") + (F.col(f"u{d}") - F.col(f"l{d}")) / 2 for d in range(dim)]


def sample_points(dim: int, n: int, seed: int) -> list[list[Column]]:
    """n random points of each rectangle; a seed makes them repeatable for rows in the same places."""
    return [[F.col(f"l{d}") + F.rand(seed + k * dim + d) * (F.col(f"u{d}") - F.col(f"l{d}")) for d in range(dim)] for k in range(n)]


class ExpressionMap:
    """A point map in column expressions, sampled at the corners, the centre or random points of each rectangle."""

    def __init__(self, f: PointMap, mode: str = "corners", padding: bool = False, points: int = 10, seed: int = 0):
        if mode not in ("corners", "center", "random"):
            raise ValueError(f"no such mode: {mode}")
        self.f, self.mode, self.padding, self.points, self.seed = f, mode, padding or mode == "center", points, seed

    def image(self, rects: DataFrame, dim: int) -> DataFrame:
        points = {"corners": lambda: corner_points(dim), "center": lambda: [center_point(dim)], "random": lambda: sample_points(dim, self.points, self.seed)}[self.mode]()
        values = [list(self.f(p)) for p in points]
        out = {}
        for d in range(dim):
            lo, hi = _least([v[d] for v in values]), _greatest([v[d] for v in values])
            if self.padding:
                width = F.col(f"u{d}") - F.col(f"l{d}")
                lo, hi = lo - width, hi + width
            out[f"fl{d}"], out[f"fu{d}"] = lo, hi
        return rects.withColumns(out)


class IntervalMap:
    """A map in interval arithmetic."""

    def __init__(self, f: Callable[[list[Interval]], Sequence[Interval]]):
        self.f = f

    def image(self, rects: DataFrame, dim: int) -> DataFrame:
        values = self.f([Interval(F.col(f"l{d}"), F.col(f"u{d}")) for d in range(dim)])
        return rects.withColumns({name: x for d, v in enumerate(values) for name, x in ((f"fl{d}", v.lo), (f"fu{d}", v.hi))})


class BatchMap:
    """A Python function of an array (n, 2 D): D lower bounds, D upper bounds a row; the like comes back. Runs on Arrow batches."""

    def __init__(self, f: Callable[[np.ndarray], np.ndarray]):
        self.f = f

    def image(self, rects: DataFrame, dim: int) -> DataFrame:
        f = self.f
        given = [f"l{d}" for d in range(dim)] + [f"u{d}" for d in range(dim)]
        made = [f"fl{d}" for d in range(dim)] + [f"fu{d}" for d in range(dim)]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                value = f(b[given].to_numpy(np.float64))
                if not isinstance(value, np.ndarray):
                    raise RuntimeError("the batch map must return an array")
                if value.shape != (len(b), 2 * dim):
                    raise RuntimeError(f"the batch map must return shape {(len(b), 2 * dim)}, not {value.shape}")
                yield b.assign(**{name: value[:, k].astype(np.float64) for k, name in enumerate(made)})

        old = ", ".join(f"`{c}` {t}" for c, t in rects.dtypes)
        return rects.mapInPandas(work, f"{old}, " + ", ".join(f"{name} double" for name in made))


def scalar_map(f: Callable[[list[float]], Sequence[float]]) -> BatchMap:
    """A Python function of one rectangle: a list of D lower and D upper bounds."""
    return BatchMap(lambda rects: np.array([list(f(r)) for r in rects.tolist()], np.float64).reshape(rects.shape))


def point_batch(f: Callable[[np.ndarray], np.ndarray], mode: str = "corners", padding: bool = False) -> BatchMap:
    """A vectorised point map, (n, D) to (n, D), sampled at corners or centres of the rectangles of a batch."""
    if mode not in ("corners", "center"):
        raise ValueError(f"no such mode for batches: {mode}")

    def rects(r: np.ndarray) -> np.ndarray:
        dim = r.shape[1] // 2
        lo, hi = r[:, :dim], r[:, dim:]
        if mode == "center":
            points = (lo + (hi - lo) / 2)[None]
        else:
            points = np.stack([np.where(np.array(s, bool), hi, lo) for s in product((0, 1), repeat=dim)])
        values = np.stack([f(p) for p in points])
        pad = hi - lo if padding or mode == "center" else 0.0
        return np.hstack([values.min(0) - pad, values.max(0) + pad])

    return BatchMap(rects)


def rk4(field: Callable[[np.ndarray], np.ndarray], time: float, steps: int) -> Callable[[np.ndarray], np.ndarray]:
    """The time map of an autonomous vector field, vectorised, for point_batch()."""

    def flow(x: np.ndarray) -> np.ndarray:
        h = time / steps
        for _ in range(steps):
            a = field(x)
            b = field(x + h / 2 * a)
            c = field(x + h / 2 * b)
            x = x + h / 6 * (a + 2 * b + 2 * c + field(x + h * c))
        return x

    return flow


# --- sampled maps -----------------------------------------------------------------------------------------------------


#: Halvings of each axis at most, samples in a finest bin, about, and levels above it that are made of the finest bins themselves.
MOST_HALVINGS, IN_BIN, LOWEST = 20, 8, 3
#: Bins of rectangles that may be broadcast, about 100 bytes each.
BROADCAST_ROWS = 300_000


class DataMap:
    """A map known from samples x0 ... y0 ...: the hull of the values whose x lies in a rectangle.

    Samples lie in dyadic bins, about IN_BIN in a finest one, and a pyramid has the hull and number of the samples of each bin of each
    size. A rectangle is taken apart: bins that it holds wholly, as large ones as there are, answer from the pyramid. So do the finest bins along
    its border, where all their samples are inside or all outside, as with boxes of a grid; only the others are looked up among
    the samples, with an exact filter. Both are equi-joins, and hulls are min/max aggregates with map-side combine. A rectangle over all samples costs one row. Bins are compared by their numbers alone, and
    a bin strictly between those of both ends is inside whatever rounding did.

    empty says what a rectangle without samples gets: "interp" doubles it about its centre until it has some, "outside" a rectangle one to two
    units above the domain, "terminate" an error. How often it is doubled comes from one search in the pyramid: the least number of
    doublings at which it meets a bin with samples, of about its own size, and the number at which it is sure to hold that bin, bound the
    few that are tried, all at once. domain_padding takes, instead of the rectangle's own samples, those of
    the rectangle padded by its width, once it has any.
    """

    def __init__(self, samples: DataFrame, domain: Domain, padding: bool = False, domain_padding: bool = False, empty: str = "interp", count: int | None = None):
        if empty not in ("interp", "outside", "terminate"):
            raise ValueError(f"no such policy: {empty}")
        self.samples, self.domain, self.padding, self.domain_padding, self.empty = samples, domain, padding, domain_padding, empty
        self.count = samples.count() if count is None else count
        self.halvings = max(0, min(MOST_HALVINGS, int(log2(max(1, self.count / IN_BIN)) / domain.dim)))
        self._tables: tuple[DataFrame, DataFrame, dict[str, float]] | None = None

    def _bin(self, x: Column, d: int) -> Column:
        n = 1 << self.halvings
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - self.domain.lo[d]) / self.domain.widths()[d] * n))).cast("int")

    def tables(self) -> tuple[DataFrame, DataFrame, dict[str, float]]:
        """Samples with their bins b0 ...; the pyramid (level, b0 ..., fl0, fu0 ..., least and largest x as xl0, xu0 ..., points); the least and largest x along each axis. Made once."""
        if self._tables is None:
            from dynspark.plans.cutting import cut

            every = range(self.domain.dim)
            names = [f"b{d}" for d in every]
            placed = self.samples.filter(reduce(Column.__and__, [F.col(f"x{d}").isNotNull() for d in every]))  # least() and min() pass over nulls
            binned = cut(placed.withColumns({f"b{d}": self._bin(F.col(f"x{d}"), d) for d in every}))
            hull = [x for d in every for x in (F.min(f"y{d}").alias(f"fl{d}"), F.max(f"y{d}").alias(f"fu{d}"), F.min(f"x{d}").alias(f"xl{d}"), F.max(f"x{d}").alias(f"xu{d}"))]
            finest = cut(binned.groupBy(*names).agg(*hull, F.count(F.lit(1)).alias("points")).withColumn("level", F.lit(self.halvings)))
            # the largest bins from bins of a middle size, of which there are few: each finest one counts in LOWEST levels, however many there are
            middle = max(0, self.halvings - LOWEST)
            low = cut(self._upwards(finest, middle, self.halvings - 1) if self.halvings else finest.limit(0))
            pyramid = finest.unionByName(low)
            if middle:
                pyramid = pyramid.unionByName(cut(self._upwards(low.filter(F.col("level") == middle), 0, middle - 1)))
            ends = pyramid.filter("level = 0").select(*[F.col(f"x{e}{d}").alias(f"{n}{d}") for d in every for e, n in (("l", "min"), ("u", "max"))]).first()
            self._tables = binned, pyramid, ends.asDict() if ends else {f"{n}{d}": None for d in every for n in ("min", "max")}
        return self._tables

    def _upwards(self, bins: DataFrame, first: int, last: int) -> DataFrame:
        """The pyramid's levels first to last from bins of a finer one."""
        every = range(self.domain.dim)
        up = bins.withColumn("__level", F.explode(F.sequence(F.lit(first), F.lit(last))))
        up = up.withColumns({f"b{d}": F.call_function("shiftright", F.col(f"b{d}"), F.col("level") - F.col("__level")) for d in every})
        more = [x for d in every for x in (F.min(f"xl{d}").alias(f"xl{d}"), F.max(f"xu{d}").alias(f"xu{d}"))]
        up = up.groupBy("__level", *[f"b{d}" for d in every]).agg(*self._hull(), *more, F.sum("points").alias("points"))
        return up.withColumnRenamed("__level", "level").select(*bins.columns)

    def _hull(self) -> list[Column]:
        return [x for d in range(self.domain.dim) for x in (F.min(f"fl{d}").alias(f"fl{d}"), F.max(f"fu{d}").alias(f"fu{d}"))]

    def _inner(self, d: int) -> tuple[Column, Column]:
        """The finest bins along an axis between which those lie that [l, u] holds wholly: of its ends, -1 and one after the last where no sample is beyond."""
        ends, n = self.tables()[2], 1 << self.halvings
        lo, hi = F.col(f"l{d}"), F.col(f"u{d}")
        return F.when(lo <= ends[f"min{d}"], -1).otherwise(self._bin(lo, d)), F.when(hi >= ends[f"max{d}"], n).otherwise(self._bin(hi, d))

    @staticmethod
    def _without(level: Column, outer: list[tuple[Column, Column]], inner: list[tuple[Column, Column]]) -> Column:
        """The boxes of integers, as structs of a level and ranges by axis, that make up outer without inner, which lies in it if it isn't empty."""
        some = reduce(Column.__and__, [a <= b for a, b in inner])
        box = lambda ranges: F.struct(level.alias("level"), *[x.alias(f"{e}{d}") for d, r in enumerate(ranges) for x, e in zip(r, "ab", strict=True)])
        out = [F.when(~some, box(outer))]
        for d, ((a, b), (ia, ib)) in enumerate(zip(outer, inner, strict=True)):
            out += [F.when(some, box([*inner[:d], side, *outer[d + 1 :]])) for side in ((a, ia - 1), (ib + 1, b))]
        full = lambda x: x.isNotNull() & reduce(Column.__and__, [x[f"a{d}"] <= x[f"b{d}"] for d in range(len(outer))])
        return F.filter(F.array(*out), full)

    def _bins(self, rects: DataFrame, pieces: Column, keep: list[str]) -> DataFrame:
        """keep, level, b0 ... of the bins in pieces (ranges by axis)."""
        out = rects.select(*keep, F.explode(pieces).alias("p"))
        for d in range(self.domain.dim):
            out = out.withColumn(f"b{d}", F.explode(F.sequence(F.col(f"p.a{d}"), F.col(f"p.b{d}"))))
        return out.select(*keep, F.col("p.level").alias("level"), *[f"b{d}" for d in range(self.domain.dim)])

    def hulls(self, rects: DataFrame, dim: int, by: list[str] | None = None) -> DataFrame:
        """by (row), fl0, fu0 ..., points for those rects (by, l0, u0 ...) that hold samples."""
        from dynspark.plans.cutting import cut

        by, binned, pyramid = by or ["row"], *self.tables()[:2]
        deep, names, ends = self.halvings, [f"b{d}" for d in range(dim)], rect_columns(dim)
        # a small table has one partition, and a rectangle may have thousands of bins along its border
        rects = rects.select(*by, *ends).repartition(rects.sparkSession.sparkContext.defaultParallelism, *by)
        rects = rects.withColumns({f"{e}{d}": x.cast("int") for d in range(dim) for e, x in zip(("__a", "__b"), self._inner(d), strict=True)})
        shift = lambda name, x, s: F.call_function(name, x, s.cast("int"))

        def held(level: Column) -> list[tuple[Column, Column]]:
            """Ranges of the bins of a level that are held wholly."""
            s = F.lit(deep) - level
            up = lambda d: F.col(f"__a{d}") + shift("shiftleft", F.lit(1), s)
            return [(shift("shiftright", up(d), s), shift("shiftright", F.col(f"__b{d}"), s) - 1) for d in range(dim)]

        def of_level(level: Column) -> Column:
            before = [(a * 2, b * 2 + 1) for a, b in held(level - 1)]
            never = [(F.lit(1), F.lit(0))] * dim
            return self._without(level, held(level), [(F.when(level > 0, a).otherwise(x), F.when(level > 0, b).otherwise(y)) for (a, b), (x, y) in zip(before, never, strict=True)])

        whole = self._bins(rects, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(deep)), of_level)), [*by, *ends])
        met = [(F.greatest(F.col(f"__a{d}"), F.lit(0)), F.least(F.col(f"__b{d}"), F.lit((1 << deep) - 1))) for d in range(dim)]
        inside = [(F.col(f"__a{d}") + 1, F.col(f"__b{d}") - 1) for d in range(dim)]
        border = self._bins(rects, self._without(F.lit(deep), met, inside), [*by, *ends])
        # counted, as Spark takes the bins for as small a table as rects and would send any number of them through the driver
        bins, many = whole.withColumn("held", F.lit(True)).unionByName(border.withColumn("held", F.lit(False))), Observation()
        bins = cut(bins.observe(many, F.count(F.lit(1)).alias("bins")))
        asked = (F.broadcast(bins) if many.get["bins"] <= BROADCAST_ROWS else bins.hint("merge")).join(pyramid, ["level", *names])
        all_in = reduce(Column.__and__, [(F.col(f"xl{d}") >= F.col(f"l{d}")) & (F.col(f"xu{d}") <= F.col(f"u{d}")) for d in range(dim)])
        some_in = reduce(Column.__and__, [(F.col(f"xu{d}") >= F.col(f"l{d}")) & (F.col(f"xl{d}") <= F.col(f"u{d}")) for d in range(dim)])
        hull, seen = [f"f{e}{d}" for d in range(dim) for e in "lu"], Observation()
        asked = asked.filter(F.col("held") | some_in).withColumn("held", F.col("held") | all_in).select(*by, *ends, *names, *hull, "points", "held")
        asked = cut(asked.observe(seen, F.count(F.when(~F.col("held"), 1)).alias("open")))
        found = asked.filter("held").select(*by, *hull, "points")
        if seen.get["open"]:
            border = asked.filter("not held").select(*by, *ends, *names)
            border = (F.broadcast(border) if seen.get["open"] <= BROADCAST_ROWS else border.hint("merge")).join(binned, names)
            border = border.filter(reduce(Column.__and__, [(F.col(f"x{d}") >= F.col(f"l{d}")) & (F.col(f"x{d}") <= F.col(f"u{d}")) for d in range(dim)]))
            found = found.unionByName(border.select(*by, *[F.col(f"y{h[2:]}").alias(h) for h in hull], F.lit(1).cast("long").alias("points")))
        return found.groupBy(*by).agg(*self._hull(), F.sum("points").alias("points"))

    def _grown(self, rects: DataFrame, dim: int, times: str) -> DataFrame:
        """rects doubled about their centres so many times, one after another."""
        ends = rect_columns(dim)
        step = lambda r, _: F.struct(*[((r[f"l{d}"] + r[f"u{d}"]) / 2 + (r[f"u{d}"] - r[f"l{d}"]) * (-1.0 if e == "l" else 1.0)).alias(f"{e}{d}") for d in range(dim) for e in "lu"])
        grown = F.when(F.col(times) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.col(times), F.lit(1))), F.struct(*ends), step)).otherwise(F.struct(*ends))
        return rects.withColumn("__g", grown).withColumns({x: F.col(f"__g.{x}") for x in ends}).drop("__g")

    def _nearest(self, missing: DataFrame, dim: int) -> DataFrame:
        """row, fl0, fu0 ... of rects without samples, doubled until they have some."""
        pyramid, ends = self.tables()[1:]
        deep, names, every = self.halvings, [f"b{d}" for d in range(dim)], range(dim)
        wide = [F.col(f"u{d}") - F.col(f"l{d}") for d in every]
        far = [F.greatest((F.col(f"l{d}") + F.col(f"u{d}")) / 2 - ends[f"min{d}"], F.lit(ends[f"max{d}"]) - (F.col(f"l{d}") + F.col(f"u{d}")) / 2, F.lit(0.0)) for d in every]
        most = F.least(F.lit(64), _greatest([F.when(w > 0, F.ceil(F.log2(F.greatest(2 * f / w, F.lit(1.0)))) + 1).otherwise(64) for w, f in zip(wide, far, strict=True)])).cast("int")
        tried = self._grown(missing.withColumn("m", F.explode(F.sequence(F.lit(1), most))), dim, "m")
        # of the bins at least as wide as the rectangle the smallest, so it meets few of them
        share = [w / self.domain.widths()[d] for d, w in enumerate(wide)]
        tried = tried.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(deep), F.floor(-F.log2(_greatest(share))))).cast("int")).withColumn("h", _least(share) / 2)
        own = tried
        for d in every:
            at = lambda e: F.call_function("shiftright", self._bin(F.col(f"{e}{d}"), d), F.lit(deep) - F.col("level"))  # noqa: B023, E731
            own = own.withColumn(f"b{d}", F.explode(F.sequence(at("l"), at("u"))))
        near = own.hint("merge").join(pyramid.select("level", *names), ["level", *names], "left_semi")
        # from the first one on that meets a bin with samples to the one that surely holds this bin; samples outside the domain lie in its outer bins, so these are tried to the end
        outer = any(ends[f"min{d}"] < self.domain.lo[d] or ends[f"max{d}"] > self.domain.hi[d] for d in every)
        sure = F.when(F.col("h") > 0, F.col("m") + F.ceil(F.log2(1 + F.pow(F.lit(2.0), -F.col("level")) / F.col("h"))) + 1).otherwise(64)
        window = near.groupBy("row").agg(F.min(F.struct("m", sure.alias("to"))).alias("w"))
        upto = F.least(F.col("most"), F.lit(64) if outer else F.col("w.to"))
        asked = missing.withColumn("most", most).join(window, "row").withColumn("m", F.explode(F.sequence(F.col("w.m"), upto.cast("int"))))
        found = self.hulls(self._grown(asked, dim, "m"), dim, ["row", "m"])
        values = [f"f{e}{d}" for d in every for e in "lu"]
        found = found.groupBy("row").agg(F.min(F.struct("m", *values, "points")).alias("x"))
        lost = F.raise_error(F.lit("a rectangle is too far from all samples")).cast("double")
        return missing.select("row").join(found, "row", "left").select("row", *[F.coalesce(f"x.{v}", lost).alias(v) for v in values], "x.points")

    def image(self, rects: DataFrame, dim: int) -> DataFrame:
        from dynspark.plans.cutting import cut

        names = rect_columns(dim)
        numbered = cut(rects.withColumn("row", F.monotonically_increasing_id()))
        own = numbered.select("row", *names)
        padded = lambda df: df.withColumns({name: F.col(name) + (F.col(f"u{name[1:]}") - F.col(f"l{name[1:]}")) * (-1 if name[0] == "l" else 1) for name in names})
        found = cut(self.hulls(own, dim))
        if self.domain_padding:
            found = cut(self.hulls(padded(own.join(found, "row", "left_semi")), dim))
        if self.empty != "outside":
            missing = cut(own.join(found, "row", "left_anti"))
            if not missing.isEmpty():
                if self.empty == "terminate":
                    raise ValueError("a rectangle holds no sample")
                if self.count == 0:
                    raise ValueError("there are no samples to interpolate from")
                found = found.unionByName(self._nearest(missing, dim))
        out = numbered.join(found.drop("points"), "row", "left")
        ends = {}
        for d in range(dim):
            lo, hi = F.col(f"fl{d}"), F.col(f"fu{d}")
            if self.padding:
                width = F.col(f"u{d}") - F.col(f"l{d}")
                lo, hi = lo - width, hi + width
            if self.empty == "outside":
                lo, hi = F.coalesce(lo, F.lit(self.domain.hi[d] + 1.0)), F.coalesce(hi, F.lit(self.domain.hi[d] + 2.0))
            ends[f"fl{d}"], ends[f"fu{d}"] = lo, hi
        return out.withColumns(ends).drop("row")


class LatticeMap:
    """A point map tabulated once at the corners (or centres) of all boxes of a depth; images are looked up by equi-joins."""

    def __init__(self, spark, f: PointMap, domain: Domain, depth: int, mode: str = "corners", padding: bool = False, most_nodes: int = 1 << 31):
        from dynspark.functions.keys import halvings
        from dynspark.operators.grid import lattice

        if mode not in ("corners", "center"):
            raise ValueError(f"no such mode: {mode}")
        self.domain, self.mode, self.padding = domain, mode, padding or mode == "center"
        self.cells = [1 << t for t in halvings(depth, domain.dim)]
        self.nodes = [n + 1 if mode == "corners" else n for n in self.cells]
        if reduce(int.__mul__, self.nodes, 1) > most_nodes:
            raise ValueError("the lattice has too many nodes")
        shift = 0.0 if mode == "corners" else 0.5
        table = lattice(spark, self.nodes)
        points = [domain.lo[d] + (F.col(f"c{d}") + shift) / n * w for d, (n, w) in enumerate(zip(self.cells, domain.widths(), strict=True))]
        self.table = table.select("id", *[v.alias(f"y{d}") for d, v in enumerate(f(points))])

    def _index(self, x: Column, d: int, shift: float) -> Column:
        """The lattice's nearest index; an error more than a hundredth of a cell away from it."""
        raw = (x - self.domain.lo[d]) / self.domain.widths()[d] * self.cells[d] - shift
        off = F.abs(raw - F.round(raw)) > 0.01
        return F.when(off, F.raise_error(F.lit("a rectangle isn't on the lattice")).cast("long")).otherwise(F.round(raw).cast("long"))

    def image(self, rects: DataFrame, dim: int) -> DataFrame:
        from dynspark.operators.grid import lattice_id

        points = corner_points(dim) if self.mode == "corners" else [center_point(dim)]
        shift = 0.0 if self.mode == "corners" else 0.5
        ids = [lattice_id([self._index(x, d, shift) for d, x in enumerate(p)], self.nodes) for p in points]
        numbered = rects.withColumn("__row", F.monotonically_increasing_id())
        asked = numbered.select("*", F.explode(F.array(*ids)).alias("id"))
        hull = [x for d in range(dim) for x in (F.min(f"y{d}").alias(f"fl{d}"), F.max(f"y{d}").alias(f"fu{d}"))]
        out = asked.join(self.table, "id").groupBy("__row", *rects.columns).agg(*hull).drop("__row")
        if self.padding:
            out = out.withColumns({f"f{e}{d}": F.col(f"f{e}{d}") + (F.col(f"u{d}") - F.col(f"l{d}")) * (-1 if e == "l" else 1) for d in range(dim) for e in "lu"})
        return out
