"""Reading and writing what the engine works on: samples, sets of boxes, graphs, settings."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynspark.functions.boxes import Domain
from dynspark.plans.morse import BoxMap, Model, MorseGraph


def read_samples(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """x0 ... y0 ... from text: numbers between white space, D of x and D of y a line. Empty lines and # comments don't count."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    parts = F.split(line, " ")
    rows = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    return rows.select(*[parts[d].cast("double").alias(f"x{d}") for d in range(dim)], *[parts[dim + d].cast("double").alias(f"y{d}") for d in range(dim)])


def box_rows(boxes: DataFrame, dim: int) -> DataFrame:
    """D lower ends, D upper ends, vertex: the columns of a file of Morse sets."""
    return boxes.select(*[f"l{d}" for d in range(dim)], *[f"u{d}" for d in range(dim)], F.col("v").cast("double").alias("v"))


def write_sets(boxes: DataFrame, path: str, dim: int) -> None:
    box_rows(boxes, dim).write.mode("overwrite").csv(path)


def read_sets(spark: SparkSession, path: str, dim: int) -> DataFrame:
    names = [f"l{d}" for d in range(dim)] + [f"u{d}" for d in range(dim)] + ["v"]
    return spark.read.schema(", ".join(f"{n} double" for n in names)).csv(path).withColumn("v", F.col("v").cast("long"))


def save(graph: MorseGraph, path: str) -> None:
    """A Morse graph as Parquet tables, its model's domain and depths with it; load() makes it again."""
    for name in ("vertices", "members", "phase"):
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")
    graph.edges_unreduced.write.mode("overwrite").parquet(f"{path}/edges")
    m = graph.model
    row = (list(m.domain.lo), list(m.domain.hi), list(m.domain.periodic), m.min, m.max, m.init, m.limit, m.strict_periodic)
    kinds = "lo array<double>, hi array<double>, periodic array<boolean>, min int, max int, init int, limit long, strict boolean"
    graph.vertices.sparkSession.createDataFrame([row], kinds).write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str, map: BoxMap | None = None) -> MorseGraph:
    """The Morse graph that was saved. A map isn't saved; map_graph() alone needs it."""
    tables = load_tables(spark, path)
    r = spark.read.parquet(f"{path}/model").first()
    model = Model(Domain(r["lo"], r["hi"], r["periodic"]), map, r["min"], r["max"], r["init"], r["limit"], r["strict"])
    return MorseGraph(model, tables["vertices"], tables["members"], tables["edges"], tables["phase"])


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("vertices", "members", "edges", "phase")}


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """value: "src degree dst dst ..." a vertex, destinations ascending. A vertex's destinations are one line, so they are gathered."""
    grouped = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    return grouped.select(F.concat_ws(" ", F.col("src").cast("string"), F.size("to").cast("string"), F.array_join(F.col("to").cast("array<string>"), " ")).alias("value"))


def dot_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """line: a DOT statement for each vertex (v, label) and edge (u, v)."""
    color = F.concat(F.lit("0."), F.lpad(F.pmod(F.col("v") * 382, F.lit(1000)).cast("string"), 3, "0"), F.lit(" 0.500 0.900"))  # hues a golden section apart
    nodes = vertices.select(F.concat(F.col("v").cast("string"), F.lit(' [label="'), F.col("label"), F.lit('", style=filled, fillcolor="'), color, F.lit('"];')).alias("line"))
    return nodes.unionByName(edges.select(F.concat(F.col("u").cast("string"), F.lit(" -> "), F.col("v").cast("string"), F.lit(";")).alias("line")))


def labels(vertices: DataFrame, name: str) -> DataFrame:
    """vertices with label: their name and, if they have notes, those, a line each."""
    notes = F.col("notes") if "notes" in vertices.columns else F.array().cast("array<string>")
    return vertices.withColumn("label", F.array_join(F.concat(F.array(F.col(name).cast("string")), notes), "\\n"))


def dot_text(graph: MorseGraph) -> str:
    """The whole of a Morse graph in DOT. A Morse graph is small: its vertices are recurrent sets."""
    edges = graph.edges()
    lines = [r["line"] for r in dot_lines(labels(graph.vertices, "v"), edges).collect()]
    rank = lambda df: "{rank=same; " + " ".join(str(r["v"]) for r in df.orderBy("v").collect()) + " };"
    return "\n".join(["digraph {", *sorted(lines, key=lambda x: ("->" in x, x)), rank(graph.attractors()), rank(graph.repellers()), "}"])


def cubes_from_text(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """c0 ... from lines like (1,2,3), moved so that the least coordinate of each axis is 0."""
    numbers = F.regexp_extract_all("value", F.lit(r"(-?\d+)"), F.lit(1))
    rows = spark.read.text(path).select(numbers.alias("n")).filter(F.size("n") >= dim)
    rows = rows.select(*[F.col("n")[d].cast("long").alias(f"c{d}") for d in range(dim)]).distinct()
    least = F.broadcast(rows.agg(*[F.min(f"c{d}").alias(f"m{d}") for d in range(dim)]))  # one row
    return rows.join(least, F.lit(True)).select(*[(F.col(f"c{d}") - F.col(f"m{d}")).alias(f"c{d}") for d in range(dim)])


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """index, tile from text: two numbers a line, such as where a retraction sends each box."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) >= 2).select(parts[0].cast("long").alias("index"), parts[1].cast("long").alias("tile"))


def read_charts(text: str) -> dict[int, Domain]:
    """The charts of an atlas, by their numbers, from its XML; the box of a chart is its domain."""
    charts, numbers = {}, lambda node, name: tuple(map(float, node.findtext(name, "").split()))
    root = ET.fromstring(text)
    dim = int(root.findtext("dimension", "0"))
    for node in root.find("listcharts"):  # type: ignore[union-attr]
        lower, upper = numbers(node, "lbounds"), numbers(node, "ubounds")
        if not len(lower) == len(upper) == dim:
            raise ValueError(f"chart {node.findtext('id')} hasn't {dim} dimensions")
        charts[int(node.findtext("id", "0"))] = Domain(lower, upper)
    return charts


def statistics(graph: MorseGraph, seconds: float) -> DataFrame:
    """One row on a run: boxes of the final grid, sets, boxes in sets, pairs of the order, seconds."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = (count(graph.phase, "boxes"), count(graph.vertices, "sets"), count(graph.members, "boxes_in_sets"), count(graph.edges_unreduced, "pairs"))
    out = parts[0].withColumn("seconds", F.lit(float(seconds)))
    for one_row in parts[1:]:
        out = out.join(F.broadcast(one_row), F.lit(True))
    return out.select("boxes", "sets", "boxes_in_sets", "pairs", "seconds")


@dataclass(frozen=True)
class Settings:
    """A run's settings as an XML file has them."""

    name: str
    description: str
    phase: Domain
    depths: tuple[int, int, int, int]  # min, max, init, limit
    param: Domain | None = None
    param_sizes: tuple[int, ...] = field(default=())


def read_settings(text: str) -> Settings:
    root = ET.fromstring(text)
    find = lambda path, default=None: (root.findtext(path) or default)
    numbers = lambda path, kind=float: tuple(map(kind, (find(path, "") or "").split()))
    flags = lambda path: tuple(x == 1 for x in numbers(path, int))
    phase = Domain(numbers("phase/bounds/lower"), numbers("phase/bounds/upper"), flags("phase/periodic"))
    depths = tuple(int(find(f"phase/subdiv/{k}", d)) for k, d in (("min", "0"), ("max", "0"), ("init", "0"), ("limit", "10000")))
    sizes, lower = numbers("param/subdiv/sizes", int), numbers("param/bounds/lower")
    if lower and not sizes:
        depth = int(find("param/subdiv/depth", "0"))
        sizes = tuple(1 << depth for _ in lower)
    param = Domain(lower, numbers("param/bounds/upper"), flags("param/periodic")) if lower else None
    return Settings(find("model/name", ""), find("model/desc", ""), phase, depths, param, sizes)  # type: ignore[arg-type]
