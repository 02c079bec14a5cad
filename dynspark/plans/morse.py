"""Morse graphs: a grid refined where the map recurs, level by level, for all parts at once.

A node of level h is a recurrent component of a node of level h - 1, subdivided once; its name is that component's least
key. All boxes of a level have one depth, and all nodes of a level are one DataFrame, so a level is: rectangles, images,
cover, edges, recurrence. The driver sees a level's counts alone. Lineage is cut at each level.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.functions.boxes import Domain, rects_of, with_cells, with_rects
from dynspark.functions.keys import halvings, left_aligned
from dynspark.operators import cover as covers
from dynspark.operators import graph, grid
from dynspark.plans.cutting import cut


class BoxMap(Protocol):
    def image(self, rects: DataFrame, dim: int) -> DataFrame: ...


@dataclass(frozen=True)
class Model:
    """What to compute: refinement depths, limit, domain and map.

    Final sets live at depth min; max only tells which of them persist. A node of more than limit boxes isn't decomposed
    below min.
    """

    domain: Domain
    map: BoxMap
    min: int
    max: int
    init: int = 0
    limit: int = 10000
    strict_periodic: bool = True
    group_edges: int = field(default=graph.GROUP_EDGES)

    def __post_init__(self) -> None:
        if not 0 <= self.init <= self.min <= self.max:
            raise ValueError("depths must be 0 <= init <= min <= max")
        if self.max > 60:
            raise ValueError("at most 60 subdivisions")


def uniform_model(domain: Domain, map: BoxMap, depth: int, **more) -> Model:
    return Model(domain, map, depth, depth, depth, **more)


def transitions(model: Model, boxes: DataFrame, depth: int) -> DataFrame:
    """node, src, dst among boxes (node, key, c0 ...): which boxes of its node does a box's image meet."""
    cells = [f"c{d}" for d in range(model.domain.dim)]
    rects = rects_of(boxes.select("node", F.col("key").alias("src"), *cells), halvings(depth, model.domain.dim), model.domain).drop(*cells)
    met = covers.cover_cells(model.map.image(rects, model.domain.dim), depth, model.domain, ["node", "src"], model.strict_periodic)
    return met.join(boxes.select("node", F.col("key").alias("dst"), *cells), ["node", *cells]).select("node", "src", "dst")


class MorseGraph:
    """vertices: v, depth, size, least (its least key); edges: u, v, all pairs of the order that are known; members: v, key; phase: depth, key, ge."""

    def __init__(self, model: Model, vertices: DataFrame, members: DataFrame, pairs: DataFrame, phase: DataFrame):
        self.model, self.vertices, self.members, self.edges_unreduced, self.phase = model, vertices, members, pairs, phase

    def edges(self) -> DataFrame:
        return graph.transitive_reduction(self.edges_unreduced)

    def adjacencies(self, v: int) -> DataFrame:
        return self.edges().filter(F.col("u") == v).select("v")

    def num_vertices(self) -> int:
        return self.vertices.count()

    def attractors(self) -> DataFrame:
        return graph.attractors(self.vertices.select("v"), self.edges_unreduced)

    def repellers(self) -> DataFrame:
        return graph.repellers(self.vertices.select("v"), self.edges_unreduced)

    def annotated(self, notes: DataFrame) -> MorseGraph:
        """The same graph whose vertices have notes (v, note), which show in its DOT text."""
        return MorseGraph(self.model, graph.annotated(self.vertices, notes), self.members, self.edges_unreduced, self.phase)

    def morse_sets(self) -> DataFrame:
        """v, depth, key, ge: the boxes of the phase grid in each set. Leaves that were refined below a set's box count for it."""
        out = [self.phase.limit(0).select(F.lit(0).alias("v"), "depth", "key", "ge")]
        for depth in sorted(r["depth"] for r in self.phase.select("depth").distinct().collect()):
            if depth >= self.model.min:
                own = self.phase.filter(F.col("depth") == depth)
                out.append(own.withColumn("__at", F.shiftright("key", depth - self.model.min)).join(self.members.withColumnRenamed("key", "__at"), "__at").select("v", "depth", "key", "ge"))
        return reduce(DataFrame.unionByName, out)

    def boxes(self) -> DataFrame:
        """v, l0, u0 ... of the sets' boxes at depth min."""
        return with_rects(self.members, self.model.min, self.model.domain).drop("key")

    def phase_boxes(self) -> DataFrame:
        depths = sorted(r["depth"] for r in self.phase.select("depth").distinct().collect())
        return reduce(DataFrame.unionByName, [with_rects(self.phase.filter(F.col("depth") == d), d, self.model.domain) for d in depths])

    def map_graph(self) -> DataFrame:
        """src, dst (ranks) of the transitions of the final, mixed grid, by a descent of its tree."""
        return map_graph(self.phase, self.model.map, self.model.domain, self.model.strict_periodic)

    def signature(self) -> dict:
        """What doesn't depend on names: sizes, least ranks and edges in order of least rank, and the size of the grid."""
        first = self.morse_sets().groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min("ge").alias("least"))
        rows = sorted((r["least"], r["size"], r["v"]) for r in first.collect())
        name = {v: k for k, (_, _, v) in enumerate(rows)}
        return {"sizes": [s for _, s, _ in rows], "min_box": [b for b, _, _ in rows], "edges": sorted([name[r["u"]], name[r["v"]]] for r in self.edges_unreduced.collect()), "phase_size": self.phase.count()}


def map_graph(phase: DataFrame, f: BoxMap, domain: Domain, strict: bool = True) -> DataFrame:
    """src, dst (ranks) of the transitions among the boxes of a grid of mixed depth (depth, key, ge): one pass over images of all depths."""
    depths = sorted(r["depth"] for r in phase.select("depth").distinct().collect())
    rects = reduce(DataFrame.unionByName, [with_rects(phase.filter(F.col("depth") == d), d, domain) for d in depths])
    images = f.image(rects.withColumnRenamed("ge", "src").drop("depth", "key"), domain.dim)
    met = covers.cover_mixed(images, phase, depths, domain, ["src"], strict)
    return met.join(phase.select("depth", F.col("key").alias("dst"), "ge"), ["depth", "dst"]).select("src", F.col("ge").alias("dst"))


def morse_graph(spark: SparkSession, model: Model) -> MorseGraph:
    least, most = model.min - model.init, model.max - model.init
    boxes = grid.uniform(spark, model.init).select(F.lit(-1).cast("long").alias("node"), "key", F.lit(1 << model.init).cast("long").alias("size"), F.lit(None).cast("long").alias("top"))
    levels: list[dict[str, DataFrame]] = []
    for level in range(most + 1):
        boxes = cut(with_cells(boxes, model.init + level, model.domain.dim))
        active = boxes.filter(F.col("size") <= model.limit) if level > least else boxes
        members, reach = graph.recurrence_of_many(transitions(model, active, model.init + level), model.group_edges)
        nodes = boxes.groupBy("node").agg(F.first("size").alias("size"), F.first("top").alias("top"))
        levels.append({"boxes": boxes, "members": members, "reach": reach, "nodes": nodes})
        if level == most or members.isEmpty():
            break
        # top: of nodes below depth min, their ancestor one level below it
        top = F.col("comp") if level == least else F.col("top")
        sizes = members.groupBy("node", "comp").agg((F.count(F.lit(1)) * 2).alias("size")).join(nodes.select("node", "top"), "node")
        boxes = grid.subdivide(members.join(sizes.select("comp", "size", top.alias("top")), "comp").select(F.col("comp").alias("node"), "key", "size", "top"))
    return _assembled(model, levels, _lost(levels, model, least, most), least)


def _lost(levels: list[dict[str, DataFrame]], model: Model, least: int, most: int) -> DataFrame | None:
    """top of the components of depth min that recur no more when refined: none of their parts is left at depth max or
    was too large to be tried."""
    if len(levels) <= least + 1:
        return None
    alive = []
    for level in range(least + 1, len(levels)):
        own = levels[level]["nodes"]
        alive.append(own.filter(F.col("size") > model.limit).select("top"))
        if level == most:
            alive.append(own.join(levels[level]["members"].select("node").distinct(), "node", "left_semi").select("top"))
    every = levels[least + 1]["nodes"].select("top")
    return cut(every.join(reduce(DataFrame.unionByName, alive).distinct(), "top", "left_anti"))


def _assembled(model: Model, levels: list[dict[str, DataFrame]], lost: DataFrame | None, least: int) -> MorseGraph:
    spark = levels[0]["boxes"].sparkSession
    none = spark.createDataFrame([], "node long, comp long, key long")
    members = levels[least]["members"] if len(levels) > least else none
    if lost is not None:
        members = members.join(lost.select(F.col("top").alias("comp")), "comp", "left_anti")
    members = cut(members) if lost is not None else members
    sets = members.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("least"))
    numbered = cut(sets.withColumn("v", F.row_number().over(Window.orderBy("least")) - 1))  # a row a set
    # the component of each level that a vertex is in
    above = numbered.select("v", "node", "comp")
    pairs = []
    for level in range(min(least, len(levels) - 1), -1, -1):
        left, right = above.select(F.col("v").alias("u"), "node", "comp"), above.select("v", "node", F.col("comp").alias("other"))
        reach = levels[level]["reach"].filter("comp != other")
        pairs.append(left.join(reach, ["node", "comp"]).join(right, ["node", "other"]).select("u", "v"))
        if level:
            up = levels[level - 1]["members"].select("node", "comp").distinct()
            above = above.select("v", F.col("node").alias("comp")).join(up, "comp").select("v", "node", "comp")
            above = cut(above) if level % 4 == 0 else above
    edges = cut(reduce(DataFrame.unionByName, pairs).distinct()) if pairs else none.select(F.col("node").alias("u"), F.col("comp").alias("v"))
    grids = [x["boxes"].select(F.lit(model.init + k).alias("depth"), "key") for k, x in enumerate(levels[: least + 1])]
    if lost is not None:
        grids += [x["boxes"].join(lost, "top", "left_semi").select(F.lit(model.init + k).alias("depth"), "key") for k, x in enumerate(levels) if k > least]
    phase = grid.joined_and_ranked(*grids)
    vertices = numbered.select("v", F.lit(model.min).alias("depth"), "size", "least")
    named = members.join(numbered.select("node", "comp", "v"), ["node", "comp"]).select("v", "key")
    return MorseGraph(model, vertices, named, edges, phase)


def order_of_leaves(df: DataFrame) -> DataFrame:
    return df.orderBy(left_aligned(F.col("key"), F.col("depth")))
