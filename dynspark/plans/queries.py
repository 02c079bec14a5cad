"""The engine's operators on the tables of a folder, and the DuckDB SQL that gives the same rows.

Points come from tables: P1 is lineitem (quantity, price) scaled to [0, 1.2]^2, P2 successive values of a user's events
(x: values t, t+1; y: values t+1, t+2) in [0, 500]^2, P3 the first two components of embeddings in [-1, 1]^2. Boxes are
those that points lie in, so all work follows the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.functions import fields
from dynspark.functions import intervals as iv
from dynspark.functions.boxes import Domain, added, centroid, meet, rect_columns, rects_of, scaled, with_cells, with_rects
from dynspark.functions.keys import child, halvings, is_upper, key_of, parent
from dynspark.operators import cells as cubical
from dynspark.operators import cover as covers
from dynspark.operators import graph, grid, maps
from dynspark.plans import morse
from dynspark.plans.cutting import cut, shared_dir
from dynspark.sources import files

UNIT = Domain((0.0, 0.0), (1.2, 1.2))
VALUES = Domain((0.0, 0.0), (500.0, 500.0))
SIGNED = Domain((-1.0, -1.0), (1.0, 1.0))
TORUS = Domain((0.0, 0.0), (1.2, 1.2), (True, True))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def product_map(x: list[Column]) -> list[Column]:
    return [c / (2.0 - c) for c in x]


PRODUCT = maps.ExpressionMap(product_map)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").filter(where)
    return rows.select(((F.col("l_quantity") - 1.0) * 1.2 / 49.0).alias("x0"), (F.col("l_extendedprice") * 1.2 / 110000.0).alias("x1"))


def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = lambda k: F.lead("value", k).over(w)
    return _table(spark, sf_dir, "events").select(F.col("value").alias("x0"), v(1).alias("x1"), v(1).alias("y0"), v(2).alias("y1")).filter("y1 is not null")


def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[d].cast("double").alias(f"x{d}") for d in range(2)])


def cell_of(depth: int, domain: Domain) -> list[Column]:
    """The coordinates of the box at depth that the point x0, x1 ... lies in."""
    t = halvings(depth, domain.dim)
    return [F.least(F.greatest(F.floor((F.col(f"x{d}") - domain.lo[d]) / domain.widths()[d] * float(1 << t[d])), F.lit(0)), F.lit((1 << t[d]) - 1)) for d in range(domain.dim)]


def occupied(points: DataFrame, depth: int, domain: Domain) -> DataFrame:
    """key, c0, c1, points: the boxes at depth that hold points."""
    counted = points.groupBy(*[c.alias(f"c{d}") for d, c in enumerate(cell_of(depth, domain))]).agg(F.count(F.lit(1)).alias("points"))
    return counted.select(key_of([F.col(f"c{d}") for d in range(domain.dim)], depth).alias("key"), *[f"c{d}" for d in range(domain.dim)], "points")


def rects(boxes: DataFrame, depth: int, domain: Domain) -> DataFrame:
    return rects_of(boxes, halvings(depth, domain.dim), domain)


# --- the same in SQL --------------------------------------------------------------------------------------------------


def sql_num(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def sql_key(coords: list[str], depth: int) -> str:
    t, dim = halvings(depth, len(coords)), len(coords)
    return " + ".join(f"(((CAST({coords[i % dim]} AS BIGINT) >> {t[i % dim] - 1 - i // dim}) & 1) << {depth - 1 - i})" for i in range(depth)) or "0"


SQL_P1 = "SELECT (l_quantity - 1e0) * 1.2e0 / 49e0 AS x0, l_extendedprice * 1.2e0 / 110000e0 AS x1 FROM lineitem"
SQL_P2 = """SELECT * FROM (SELECT value AS x0, lead(value, 1) OVER w AS x1, lead(value, 1) OVER w AS y0, lead(value, 2) OVER w AS y1
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE y1 IS NOT NULL"""
SQL_P3 = "SELECT CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1 FROM embeddings"


def sql_occupied(points: str, depth: int, domain: Domain) -> str:
    t = halvings(depth, domain.dim)
    place = ", ".join(f"CAST(least(greatest(floor((x{d} - {sql_num(domain.lo[d])}) / {sql_num(domain.widths()[d])} * {float(1 << t[d])}e0), 0), {(1 << t[d]) - 1}) AS BIGINT) AS c{d}" for d in range(domain.dim))
    names = ", ".join(f"c{d}" for d in range(domain.dim))
    return f"SELECT {sql_key([f'c{d}' for d in range(domain.dim)], depth)} AS key, {names}, count(*) AS points FROM (SELECT {place} FROM ({points})) GROUP BY {names}"


def sql_rects(boxes: str, depth: int, domain: Domain) -> str:
    t, out = halvings(depth, domain.dim), []
    for d in range(domain.dim):
        n, lo, hi = f"{float(1 << t[d])}e0", sql_num(domain.lo[d]), sql_num(domain.hi[d])
        left, right = f"(CAST(c{d} AS DOUBLE) / {n})", f"(({n} - 1e0 - CAST(c{d} AS DOUBLE)) / {n})"
        out += [f"{left} * {hi} + (1e0 - {left}) * {lo} AS l{d}", f"{right} * {lo} + (1e0 - {right}) * {hi} AS u{d}"]
    return f"SELECT *, {', '.join(out)} FROM ({boxes})"


def sql_product(boxes: str) -> str:
    f = lambda x: f"({x} / (2e0 - {x}))"
    return f"SELECT *, {', '.join(f'least({f(f"l{d}")}, {f(f"u{d}")}) AS fl{d}, greatest({f(f"l{d}")}, {f(f"u{d}")}) AS fu{d}' for d in range(2))} FROM ({boxes})"


def sql_cover(images: str, depth: int, domain: Domain, keep: str) -> str:
    """A theta join with all boxes of the depth."""
    t, ends, on = halvings(depth, domain.dim), [], []
    for d in range(domain.dim):
        lo, w, s = sql_num(domain.lo[d]), f"({sql_num(domain.hi[d])} - {sql_num(domain.lo[d])})", 60 - t[d]
        r = lambda x: f"(({x}{d} - {lo}) / {w})"  # noqa: B023, E731
        fixed = lambda x: f"CAST(trunc(1152921504606846976e0 * greatest(least({r(x)}, 1e0), 0e0)) AS BIGINT)"  # noqa: B023, E731
        ends += [f"greatest({fixed('fl')} - 1024, 0) AS lb{d}", f"least({fixed('fu')} + 1024, 1152921504606846976) AS ub{d}", f"({r('fu')} >= 0e0 AND {r('fl')} <= 1e0) AS in{d}"]
        on += [f"in{d} AND (g{d}.c << {s}) <= ub{d} AND ((g{d}.c + 1) << {s}) >= lb{d}"]
    sides = " ".join(f"JOIN (SELECT range AS c FROM range({1 << t[d]})) g{d} ON {on[d]}" for d in range(domain.dim))
    return f"SELECT {keep}, {sql_key([f'g{d}.c' for d in range(domain.dim)], depth)} AS dst FROM (SELECT {keep}, {', '.join(ends)} FROM ({images})) {sides}"


# --- boxes ------------------------------------------------------------------------------------------------------------

BOX1 = sql_occupied(SQL_P1, 12, UNIT)
BOX1_8 = sql_occupied(SQL_P1, 8, UNIT)


@query(f"SELECT key, points, l0, u0, l1, u1 FROM ({sql_rects(BOX1, 12, UNIT)})")
def q01_box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects(occupied(p1(spark, sf_dir), 12, UNIT), 12, UNIT).select("key", "points", "l0", "u0", "l1", "u1")


@query(f"SELECT key * 4 + range AS key FROM ({sql_occupied(SQL_P3, 6, SIGNED)}), range(4)")
def q02_subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.subdivide(occupied(p3(spark, sf_dir), 6, SIGNED).select("key"), 2)


@query(f"SELECT key, points FROM ({sql_occupied(SQL_P1, 14, UNIT)})")
def q03_point_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupied(p1(spark, sf_dir), 14, UNIT).select("key", "points")


@query(f"SELECT key, fl0, fu0, fl1, fu1 FROM ({sql_product(sql_rects(BOX1, 12, UNIT))})")
def q04_corner_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PRODUCT.image(rects(occupied(p1(spark, sf_dir), 12, UNIT), 12, UNIT), 2).select("key", "fl0", "fu0", "fl1", "fu1")


_MID = "(l{d} + (u{d} - l{d}) / 2)"
_CENTER = ", ".join(f"{_MID.format(d=d)} / (2e0 - {_MID.format(d=d)}) {sign} (u{d} - l{d}) AS f{name}{d}" for d in range(2) for name, sign in (("l", "-"), ("u", "+")))


@query(f"SELECT key, {_CENTER} FROM ({sql_rects(BOX1, 12, UNIT)})")
def q05_center_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = maps.ExpressionMap(product_map, "center").image(rects(occupied(p1(spark, sf_dir), 12, UNIT), 12, UNIT), 2)
    return image.select("key", "fl0", "fu0", "fl1", "fu1")


@query("""
WITH h AS (SELECT l_orderkey AS k, min(l_discount) AS a, max(l_discount) AS b, min(l_tax) AS c, max(l_tax) AS d FROM lineitem GROUP BY l_orderkey)
SELECT k, a + c AS add_lo, b + d AS add_hi, a - d AS sub_lo, b - c AS sub_hi,
  least(a * c, a * d, b * c, b * d) AS mul_lo, greatest(a * c, a * d, b * c, b * d) AS mul_hi,
  CASE WHEN a - d <= 0 AND b - c >= 0 THEN 0e0 ELSE least((a - d) * (a - d), (b - c) * (b - c)) END AS sq_lo,
  greatest((a - d) * (a - d), (b - c) * (b - c)) AS sq_hi, b * -3e0 AS neg_lo, a * -3e0 AS neg_hi FROM h""")
def q06_interval_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_discount").alias("a"), F.max("l_discount").alias("b"), F.min("l_tax").alias("c"), F.max("l_tax").alias("d"))
    x, y = iv.Interval(F.col("a"), F.col("b")), iv.Interval(F.col("c"), F.col("d"))
    named = {"add": x + y, "sub": x - y, "mul": x * y, "sq": iv.square(x - y), "neg": x * -3.0}
    return h.select("k", *[c.alias(f"{n}_{e}") for n, i in named.items() for e, c in (("lo", i.lo), ("hi", i.hi))])


# --- covers and digraphs ----------------------------------------------------------------------------------------------


def edges1(spark: SparkSession, sf_dir: str, depth: int, inside: bool) -> DataFrame:
    """src, dst of the product map on P1's boxes; inside: dst is one of them too."""
    boxes = occupied(p1(spark, sf_dir), depth, UNIT)
    image = PRODUCT.image(rects(boxes.select(F.col("key").alias("src"), "c0", "c1"), depth, UNIT).drop("c0", "c1"), 2)
    if not inside:
        return covers.cover(image, depth, UNIT, ["src"])
    met = covers.cover_cells(image, depth, UNIT, ["src"])
    return met.join(boxes.select("c0", "c1", F.col("key").alias("dst")), ["c0", "c1"]).select("src", "dst")


def sql_edges1(depth: int, inside: bool) -> str:
    boxes = sql_occupied(SQL_P1, depth, UNIT)
    edges = sql_cover(sql_product(sql_rects(f"SELECT key AS src, c0, c1 FROM ({boxes})", depth, UNIT)), depth, UNIT, "src")
    return f"SELECT src, dst FROM ({edges}) WHERE dst IN (SELECT key FROM ({boxes}))" if inside else edges


@query(sql_edges1(12, False))
def q07_cover_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges1(spark, sf_dir, 12, False)


@query(f"""WITH e AS ({sql_edges1(12, False)})
SELECT key, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS key, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY key""")
def q08_transition_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges1(spark, sf_dir, 12, False).withColumn("node", F.lit(0).cast("long"))).select("key", "out_degree", "in_degree")


@query(sql_edges1(12, True))
def q09_subgrid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges1(spark, sf_dir, 12, True)


#: Boxes, their strong components by closure, and what components reach.
SQL_RECURRENCE = f"""
WITH RECURSIVE e AS MATERIALIZED ({sql_edges1(8, True)}),
closure(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM closure JOIN e ON b = src),
mutual AS (SELECT x.a, x.b FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a),
members AS (SELECT a AS key, min(b) AS comp FROM mutual GROUP BY a),
reach AS (SELECT DISTINCT m.comp, n.comp AS other FROM closure JOIN members m ON m.key = a JOIN members n ON n.key = b)
"""


def recurrent1(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges and members of the recurrent components of the product map on P1's boxes at depth 8."""
    edges = cut(edges1(spark, sf_dir, 8, True).withColumn("node", F.lit(0).cast("long")))
    return edges, graph.components(edges)


@query(SQL_RECURRENCE + "SELECT comp, key FROM members")
def q10_morse_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent1(spark, sf_dir)[1].select("comp", "key")


@query(SQL_RECURRENCE + "SELECT comp, other FROM reach")
def q11_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges1(spark, sf_dir, 8, True).withColumn("node", F.lit(0).cast("long"))
    return graph.recurrence(edges)[1].select("comp", "other")


# --- recurrence of digraphs in several parts --------------------------------------------------------------------------

#: Lines spread over both axes; edges of a part, so that the digraph has several.
SQL_P4 = """SELECT CAST((l_partkey * 7919 + l_suppkey * 104729 + l_orderkey * 1299709 + l_linenumber * 15485863) % 1000003 AS DOUBLE) * 1.2e0 / 1000003e0 AS x0,
  l_extendedprice * 1.2e0 / 110000e0 AS x1 FROM lineitem"""
PART_EDGES = 50_000


def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.expr("(l_partkey * 7919L + l_suppkey * 104729L + l_orderkey * 1299709L + l_linenumber * 15485863L) % 1000003L").cast("double")
    return _table(spark, sf_dir, "lineitem").select((mixed * 1.2 / 1000003.0).alias("x0"), (F.col("l_extendedprice") * 1.2 / 110000.0).alias("x1"))


def edges4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product map at the centres of P4's boxes at depth 16, padded by a box's width: some 10^5 edges at 60,000 lines."""
    boxes = occupied(p4(spark, sf_dir), 16, UNIT)
    image = maps.ExpressionMap(product_map, "center").image(rects(boxes.select(F.col("key").alias("src"), "c0", "c1"), 16, UNIT).drop("c0", "c1"), 2)
    met = covers.cover_cells(image, 16, UNIT, ["src"])
    return met.join(boxes.select("c0", "c1", F.col("key").alias("dst")), ["c0", "c1"]).select(F.lit(0).cast("long").alias("node"), "src", "dst")


_BOX4 = sql_occupied(SQL_P4, 16, UNIT)
_EDGES4 = sql_cover(f"SELECT src, {_CENTER} FROM ({sql_rects(f'SELECT key AS src, c0, c1 FROM ({_BOX4})', 16, UNIT)})", 16, UNIT, "src")
SQL_RECURRENCE4 = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM ({_EDGES4}) WHERE dst IN (SELECT key FROM ({_BOX4}))),
closure(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM closure JOIN e ON b = src),
mutual AS (SELECT x.a, x.b FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a),
members AS MATERIALIZED (SELECT a AS key, min(b) AS comp FROM mutual GROUP BY a),
reach AS (SELECT DISTINCT m.comp, n.comp AS other FROM closure JOIN members m ON m.key = a JOIN members n ON n.key = b)
"""


@query(SQL_RECURRENCE4 + "SELECT comp, key FROM members")
def q51_components_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges4(spark, sf_dir), PART_EDGES).select("comp", "key")


@query(SQL_RECURRENCE4 + "SELECT comp, other FROM reach")
def q52_reachability_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recurrence(edges4(spark, sf_dir), PART_EDGES)[1].select("comp", "other")


SQL_ORDER = """
WITH flow AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b, count(*) AS n FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY ALL),
closed AS (SELECT a AS u, b AS v FROM flow WHERE a < b AND n % 2 = 0),
through AS (SELECT DISTINCT x.u, y.v FROM closed x JOIN closed y ON x.v = y.u),
reduced AS (SELECT u, v FROM closed EXCEPT SELECT u, v FROM through)
"""


def nations_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v: customers of nation u bought from suppliers of nation v > u an even number of times."""
    t = lambda n: _table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    flow = rows.groupBy(F.col("c_nationkey").alias("u"), F.col("s_nationkey").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return flow.filter("u < v and n % 2 = 0").select("u", "v")


@query(SQL_ORDER + "SELECT u, v FROM reduced")
def q12_transitive_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitive_reduction(nations_order(spark, sf_dir))


@query(SQL_ORDER + """SELECT n_nationkey AS v, n_nationkey NOT IN (SELECT u FROM closed) AS attractor, n_nationkey NOT IN (SELECT v FROM closed) AS repeller FROM nation
WHERE n_nationkey NOT IN (SELECT u FROM closed) OR n_nationkey NOT IN (SELECT v FROM closed)""")
def q13_attractors_repellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, v = nations_order(spark, sf_dir), _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v"))
    both = graph.attractors(v, edges).withColumn("a", F.lit(True)).join(graph.repellers(v, edges).withColumn("r", F.lit(True)), "v", "full")
    return both.select("v", F.coalesce("a", F.lit(False)).alias("attractor"), F.coalesce("r", F.lit(False)).alias("repeller"))


@query(SQL_RECURRENCE + "SELECT comp AS min_box, count(*) AS size FROM members GROUP BY comp")
def q14_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent1(spark, sf_dir)[1].groupBy(F.col("comp").alias("min_box")).agg(F.count(F.lit(1)).alias("size"))


# --- sampled and tabulated maps ---------------------------------------------------------------------------------------

SQL_BOX2 = sql_rects(sql_occupied(SQL_P2, 10, VALUES), 10, VALUES)


def boxes2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = p2(spark, sf_dir)
    return points, rects(occupied(points, 10, VALUES), 10, VALUES).select("key", "l0", "u0", "l1", "u1")


_INSIDE = "x0 >= l0 AND x0 <= u0 AND x1 >= l1 AND x1 <= u1"


@query(f"SELECT key, min(y0) AS fl0, max(y0) AS fu0, min(y1) AS fl1, max(y1) AS fu1, count(*) AS points FROM ({SQL_BOX2}) b JOIN ({SQL_P2}) p ON {_INSIDE} GROUP BY key")
def q15_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, boxes = boxes2(spark, sf_dir)
    return maps.DataMap(points, VALUES).hulls(boxes.withColumnRenamed("key", "row"), 2).withColumnRenamed("row", "key")


_PADDED = "x0 >= l0 - (u0 - l0) AND x0 <= u0 + (u0 - l0) AND x1 >= l1 - (u1 - l1) AND x1 <= u1 + (u1 - l1)"
SQL_ALL2 = sql_rects(f"SELECT {sql_key(['a.range', 'b.range'], 10)} AS key, a.range AS c0, b.range AS c1 FROM range(32) a, range(32) b", 10, VALUES)


@query(f"""WITH p AS MATERIALIZED ({SQL_P2}), b AS MATERIALIZED ({SQL_ALL2}), hit AS (SELECT DISTINCT key FROM b JOIN p ON {_INSIDE}),
hull AS (SELECT key, min(y0) AS a0, max(y0) AS b0, min(y1) AS a1, max(y1) AS b1 FROM b JOIN p ON {_PADDED} WHERE key IN (SELECT key FROM hit) GROUP BY key)
SELECT b.key, coalesce(a0, 501e0) AS fl0, coalesce(b0, 502e0) AS fu0, coalesce(a1, 501e0) AS fl1, coalesce(b1, 502e0) AS fu1 FROM b LEFT JOIN hull ON b.key = hull.key""")
def q16_data_map_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = p2(spark, sf_dir)
    boxes = with_rects(grid.uniform(spark, 10), 10, VALUES)
    image = maps.DataMap(points, VALUES, domain_padding=True, empty="outside").image(boxes, 2)
    return image.select("key", "fl0", "fu0", "fl1", "fu1")


SQL_ALL12 = sql_rects(f"SELECT {sql_key(['a.range', 'b.range'], 12)} AS key, a.range AS c0, b.range AS c1 FROM range(64) a, range(64) b", 12, VALUES)
_GROWN = ", ".join(f"(l{d} + u{d}) / 2 {sign} (u{d} - l{d}) AS {e}{d}" for d in range(2) for e, sign in (("l", "-"), ("u", "+")))


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({SQL_P2}), b AS MATERIALIZED (SELECT key, l0, u0, l1, u1 FROM ({SQL_ALL12})),
tried(turn, key, l0, u0, l1, u1, hit) AS (
  SELECT 0, key, l0, u0, l1, u1, EXISTS (SELECT 1 FROM p WHERE {_INSIDE}) FROM b
  UNION ALL SELECT turn + 1, key, l0, u0, l1, u1, EXISTS (SELECT 1 FROM p WHERE {_INSIDE}) FROM (SELECT turn, key, {_GROWN} FROM tried WHERE NOT hit AND turn < 20))
SELECT key, min(y0) AS fl0, max(y0) AS fu0, min(y1) AS fl1, max(y1) AS fu1 FROM (SELECT * FROM tried WHERE hit) t JOIN p ON {_INSIDE} GROUP BY key""")
def q17_data_map_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = with_rects(grid.uniform(spark, 12), 12, VALUES)
    return maps.DataMap(p2(spark, sf_dir), VALUES).image(boxes, 2).select("key", "fl0", "fu0", "fl1", "fu1")


def halves(x: list[Column]) -> list[Column]:
    return [c * (1.2 - c) for c in x]


_HALF = ", ".join(f"least(l{d} * (1.2e0 - l{d}), u{d} * (1.2e0 - u{d})) AS fl{d}, greatest(l{d} * (1.2e0 - l{d}), u{d} * (1.2e0 - u{d})) AS fu{d}" for d in range(2))


@query(f"SELECT key, round(fl0, 12) AS fl0, round(fu0, 12) AS fu0, round(fl1, 12) AS fl1, round(fu1, 12) AS fu1 FROM (SELECT key, {_HALF} FROM ({sql_rects(BOX1, 12, UNIT)}))")
def q18_lattice_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = maps.LatticeMap(spark, halves, UNIT, 12)
    image = table.image(rects(occupied(p1(spark, sf_dir), 12, UNIT), 12, UNIT).select("key", "l0", "u0", "l1", "u1"), 2)
    return image.select("key", *[F.round(c, 12).alias(c) for c in ("fl0", "fu0", "fl1", "fu1")])


# --- other covers, mixed grids, lattices ------------------------------------------------------------------------------

_SHIFT = sql_rects(BOX1_8, 8, UNIT)
_MOVED = f"SELECT key AS src, l0 + 0.9e0 AS fl0, u0 + 0.9e0 AS fu0, l1 + 0.55e0 AS fl1, u1 + 0.55e0 AS fu1 FROM ({_SHIFT})"
_DOWN = f"SELECT src, {', '.join(f'CASE WHEN fu{d} > 1.2e0 THEN f{e}{d} - 1.2e0 ELSE f{e}{d} END AS f{e}{d}' for d in range(2) for e in 'lu')} FROM ({_MOVED})"
_CAPPED = f"SELECT src, fl0, least(fu0, fl0 + 1.2e0) AS fu0, fl1, least(fu1, fl1 + 1.2e0) AS fu1 FROM ({_DOWN})"
_WRAPPED = f"SELECT src, fl0 + i AS fl0, fu0 + i AS fu0, fl1 + j AS fl1, fu1 + j AS fu1 FROM ({_CAPPED}), (VALUES (0e0), (1.2e0)) a(i), (VALUES (0e0), (1.2e0)) b(j)"


@query(f"SELECT DISTINCT src, dst FROM ({sql_cover(_WRAPPED, 8, UNIT, 'src')})")
def q19_periodic_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = rects(occupied(p1(spark, sf_dir), 8, UNIT), 8, UNIT)
    moved = boxes.select(F.col("key").alias("src"), *[(F.col(f"{e}{d}") + by).alias(f"f{e}{d}") for d, by in ((0, 0.9), (1, 0.55)) for e in "lu"])
    return covers.cover(moved, 8, TORUS, ["src"])


def _two(by: str) -> str:
    return sql_cover(f"SELECT key AS src, l0 * {by} AS fl0, u0 * {by} AS fu0, l1 * {by} AS fl1, u1 * {by} AS fu1 FROM ({_SHIFT})", 8, UNIT, "src")


@query(f"""WITH a AS ({_two('1e0')}), b AS ({_two('0.96e0')})
SELECT 'union' AS kind, src, dst FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', src, dst FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def q20_union_intersection_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = rects(occupied(p1(spark, sf_dir), 8, UNIT), 8, UNIT)
    scaled = lambda by: covers.cover(boxes.select(F.col("key").alias("src"), *[(F.col(f"{e}{d}") * by).alias(f"f{e}{d}") for d in range(2) for e in "lu"]), 8, UNIT, ["src"])
    both = [scaled(1.0), scaled(0.96)]
    return covers.union_cover(both).select(F.lit("union").alias("kind"), "src", "dst").unionByName(covers.intersection_cover(both).select(F.lit("intersection").alias("kind"), "src", "dst"))


_G3, _G1 = sql_occupied(SQL_P3, 8, SIGNED), sql_occupied(SQL_P1, 6, UNIT)


@query(f"""WITH a AS (SELECT 8 AS depth, key FROM ({_G3})), b AS (SELECT 6 AS depth, key FROM ({_G1})),
joined AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key >> 2 FROM a))
SELECT depth, key, CASE WHEN depth = 8 THEN key >> 2 ELSE key END IN (SELECT key FROM b) AS below FROM joined""")
def q21_grid_join_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = occupied(p3(spark, sf_dir), 8, SIGNED).select(F.lit(8).alias("depth"), "key")
    coarse = occupied(p1(spark, sf_dir), 6, UNIT).select(F.lit(6).alias("depth"), "key")
    joined = grid.join_grids(fine, coarse)
    inside = grid.subset(joined, coarse).withColumn("below", F.lit(True))
    return joined.join(inside, ["depth", "key"], "left").select("depth", "key", F.coalesce("below", F.lit(False)).alias("below"))


# --- grids of mixed depth ---------------------------------------------------------------------------------------------

#: Boxes of all lines, finer where some kinds of them lie; another grid to compare with.
_MIXED = ((6, "true"), (8, "l_discount > 0.05"), (11, "l_tax < 0.02"))
_OTHER = ((7, "l_quantity < 10"), (10, "l_quantity > 45"), (4, "l_extendedprice > 100000"))


def grids1(spark: SparkSession, sf_dir: str, parts: tuple[tuple[int, str], ...]) -> list[DataFrame]:
    return [occupied(p1(spark, sf_dir, where), depth, UNIT).select(F.lit(depth).alias("depth"), "key") for depth, where in parts]


def _sql_grids1(parts: tuple[tuple[int, str], ...]) -> str:
    return " UNION ALL ".join(f"SELECT {depth} AS depth, key, c0, c1 FROM ({sql_occupied(f'{SQL_P1} WHERE {where}', depth, UNIT)})" for depth, where in parts)


SQL_MIXED = f"""g AS MATERIALIZED ({_sql_grids1(_MIXED)}),
leaf AS MATERIALIZED (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.depth > g.depth AND h.key >> (h.depth - g.depth) = g.key)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY key << (62 - depth)) - 1 AS ge FROM leaf)"""


@query(f"""WITH {SQL_MIXED}, o AS MATERIALIZED ({_sql_grids1(_OTHER)})
SELECT depth, key, EXISTS (SELECT 1 FROM o WHERE (o.depth <= leaf.depth AND leaf.key >> (leaf.depth - o.depth) = o.key) OR (o.depth > leaf.depth AND o.key >> (o.depth - leaf.depth) = leaf.key)) AS near, ge
FROM leaf JOIN numbered USING (depth, key)""")
def q53_mixed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of three grids, their ranks, and which of them lie in a box of another mixed grid or hold one."""
    leaves = grid.joined_and_ranked(*grids1(spark, sf_dir, _MIXED))
    near = grid.subset(leaves, reduce(DataFrame.unionByName, grids1(spark, sf_dir, _OTHER))).select("ge", F.lit(True).alias("near"))
    return leaves.join(near, "ge", "left").select("depth", "key", F.coalesce("near", F.lit(False)).alias("near"), "ge")


def _sql_met(d: int) -> str:
    r = lambda x: f"(({x}{d} - 0.0) / (1.2 - 0.0))"
    fixed = lambda x: f"CAST(trunc(1152921504606846976e0 * greatest(least({r(x)}, 1e0), 0e0)) AS BIGINT)"
    return f"greatest({fixed('fl')} - 1024, 0) AS lb{d}, least({fixed('fu')} + 1024, 1152921504606846976) AS ub{d}, ({r('fu')} >= 0e0 AND {r('fl')} <= 1e0) AS in{d}"


_PLACED = " UNION ALL ".join(
    f"SELECT ge, l0, u0, l1, u1, c0 << {60 - halvings(depth, 2)[0]} AS a0, (c0 + 1) << {60 - halvings(depth, 2)[0]} AS b0, c1 << {60 - halvings(depth, 2)[1]} AS a1, (c1 + 1) << {60 - halvings(depth, 2)[1]} AS b1 "
    f"FROM ({sql_rects(f'SELECT * FROM numbered WHERE depth = {depth}', depth, UNIT)})"
    for depth, _ in _MIXED
)


@query(f"""WITH {SQL_MIXED}, placed AS MATERIALIZED ({_PLACED}),
asked AS MATERIALIZED (SELECT ge AS src, {_sql_met(0)}, {_sql_met(1)} FROM ({sql_product("SELECT * FROM placed")}))
SELECT src, ge AS dst FROM asked JOIN placed ON in0 AND in1 AND a0 <= ub0 AND b0 >= lb0 AND a1 <= ub1 AND b1 >= lb1""")
def q54_mixed_map_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of the product map among the leaves of a grid of three depths, by their ranks."""
    leaves = cut(grid.joined_and_ranked(*grids1(spark, sf_dir, _MIXED)))
    return morse.map_graph(leaves, PRODUCT, UNIT)


_PRISMS = f"SELECT key AS src, (l0 + u0) / 2 AS m0, (l1 + u1) / 2 AS m1, (u0 - l0) / 2 AS a00, (u1 - l1) / 4 AS a01, (l0 - u0) / 4 AS a10, (u1 - l1) * 0.7e0 AS a11 FROM ({_SHIFT})"
_BOUNDED = f"SELECT *, m0 - (abs(a00) + abs(a01)) AS fl0, m0 + (abs(a00) + abs(a01)) AS fu0, m1 - (abs(a10) + abs(a11)) AS fl1, m1 + (abs(a10) + abs(a11)) AS fu1 FROM ({_PRISMS})"
_ALL8 = sql_rects(f"SELECT {sql_key(['a.range', 'b.range'], 8)} AS dst, a.range AS c0, b.range AS c1 FROM range(16) a, range(16) b", 8, UNIT)
_FACES_APART = " AND ".join(
    f"abs(({x}) * ((l0 + u0) / 2 - m0) + ({y}) * ((l1 + u1) / 2 - m1)) <= half + abs({x}) * (u0 - l0) / 2 + abs({y}) * (u1 - l1) / 2 + 1e-9 * (1e0 + half)" for x, y in (("a11", "-a01"), ("-a10", "a00"))
)


def _skew() -> dict[str, Column]:
    """A prism about a box: matrix and centre."""
    wide = [F.col(f"u{d}") - F.col(f"l{d}") for d in range(2)]
    return {"a00": wide[0] / 2, "a01": wide[1] / 4, "a10": -wide[0] / 4, "a11": wide[1] * 0.7} | {f"m{d}": (F.col(f"l{d}") + F.col(f"u{d}")) / 2 for d in range(2)}


@query(f"""SELECT src, dst FROM (SELECT *, abs(a00 * a11 - a01 * a10) AS half FROM ({sql_cover(_BOUNDED, 8, UNIT, 'src, m0, m1, a00, a01, a10, a11')}) JOIN ({_ALL8}) USING (dst)) WHERE {_FACES_APART}""")
def q55_prism_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes that skew prisms about boxes meet."""
    boxes = rects(occupied(p1(spark, sf_dir), 8, UNIT).drop("points"), 8, UNIT)
    prisms = boxes.withColumns(_skew()).select(F.col("key").alias("src"), *[F.col(c).alias(c.replace("m", "c")) for c in _skew()])
    return covers.prism_cover(prisms, 8, UNIT, ["src"])


@query(f"""WITH b AS (SELECT c0, c1 FROM ({BOX1}))
SELECT a.c0 + 64 * a.c1 AS src, b.c0 + 64 * b.c1 AS dst FROM b a JOIN b ON abs(a.c0 - b.c0) <= 1 AND abs(a.c1 - b.c1) <= 1""")
def q22_param_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.adjacent_cells(occupied(p1(spark, sf_dir), 12, UNIT), [64, 64])


@query(f"""WITH b AS (SELECT c0, c1 FROM ({BOX1}))
SELECT DISTINCT axis, c0 + CASE WHEN axis = 1 THEN s ELSE 0 END AS c0, c1 + CASE WHEN axis = 0 THEN s ELSE 0 END AS c1 FROM b, (VALUES (0), (1)) x(axis), (VALUES (0), (1)) y(s)""")
def q23_edge_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.edges_of(occupied(p1(spark, sf_dir), 12, UNIT), 2)


_FACES = f"SELECT DISTINCT 2 * c0 + i AS e0, 2 * c1 + j AS e1 FROM ({BOX1}), (VALUES (0), (1), (2)) x(i), (VALUES (0), (1), (2)) y(j)"


@query(f"""WITH f AS ({_FACES}) SELECT CAST(e0 % 2 + e1 % 2 AS BIGINT) AS dim, count(*) AS n, (SELECT CAST(sum(CASE WHEN (e0 + e1) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) FROM f) AS euler FROM f GROUP BY ALL""")
def q24_cubical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cubical.face_counts(cubical.cells(occupied(p1(spark, sf_dir), 12, UNIT), 2))
    euler = F.sum(F.when(F.pmod("dim", F.lit(2)) == 0, F.col("n")).otherwise(-F.col("n"))).over(Window.partitionBy())
    return counts.select("dim", "n", euler.alias("euler"))


@query(f"""WITH c AS (SELECT 2 * c0 + 1 AS e0, 2 * c1 + 1 AS e1, points % 5 AS coef FROM ({BOX1})),
d AS (SELECT e0 + 1 AS e0, e1, coef FROM c UNION ALL SELECT e0 - 1, e1, -coef FROM c UNION ALL SELECT e0, e1 + 1, -coef FROM c UNION ALL SELECT e0, e1 - 1, coef FROM c)
SELECT e0, e1, CAST(((sum(coef) % 5) + 5) % 5 AS INTEGER) AS coef FROM d GROUP BY e0, e1 HAVING sum(coef) % 5 <> 0""")
def q25_chain_boundary_mod5(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = occupied(p1(spark, sf_dir), 12, UNIT)
    chain = boxes.select((F.col("c0") * 2 + 1).alias("e0"), (F.col("c1") * 2 + 1).alias("e1"), (F.col("points") % 5).alias("coef"))
    return cubical.boundary(chain, 2)


# --- navigation, ranks, lattices --------------------------------------------------------------------------------------


@query(f"""SELECT DISTINCT key >> 4 AS key, 'coarse' AS kind, ({{c0}}) AS c0, ({{c1}}) AS c1 FROM ({BOX1})
UNION ALL SELECT key * 4 + p.range, 'fine', c0 * 2 + (p.range >> 1), c1 * 2 + (p.range & 1) FROM ({BOX1}), range(4) p""".format(c0="c0 >> 2", c1="c1 >> 2"))
def q32_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes at depth 12 as cubes at depth 8 and at depth 14."""
    boxes = occupied(p1(spark, sf_dir), 12, UNIT).select("key")
    at = lambda depth, kind: grid.cubes(boxes, 12, depth, 2).select("key", F.lit(kind).alias("kind"), "c0", "c1")
    return at(8, "coarse").unionByName(at(14, "fine"))


_PARENT = sql_occupied(SQL_P1, 12, UNIT)


@query(f"""SELECT key, key >> 1 AS up, key >> 3 AS up3, key * 2 AS lower, key * 2 + 1 AS upper, key % 2 = 1 AS is_upper FROM ({_PARENT})""")
def q33_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("key")
    boxes = occupied(p1(spark, sf_dir), 12, UNIT).select("key")
    return boxes.select("key", parent(key).alias("up"), parent(key, 3).alias("up3"), child(key, 0).alias("lower"), child(key, 1).alias("upper"), is_upper(key).alias("is_upper"))


@query(f"""WITH a AS (SELECT 8 AS depth, key FROM ({_G3})), b AS (SELECT 6 AS depth, key FROM ({_G1})),
joined AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key >> 2 FROM a))
SELECT depth, key, row_number() OVER (ORDER BY key << (62 - depth)) - 1 AS ge FROM joined""")
def q34_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of each leaf of a grid of mixed depth in a walk of its tree."""
    fine = occupied(p3(spark, sf_dir), 8, SIGNED).select(F.lit(8).alias("depth"), "key")
    coarse = occupied(p1(spark, sf_dir), 6, UNIT).select(F.lit(6).alias("depth"), "key")
    return grid.ranked(grid.join_grids(fine, coarse)).select("depth", "key", "ge")


_LATTICE = [37, 23]
_CELL = " AND ".join(f"c{d} >= greatest(ceil({n}e0 * (l{d} - 0e0) / (1.2e0 - 0e0) - 1e0), 0) AND c{d} < least(floor({n}e0 * (u{d} - 0e0) / (1.2e0 - 0e0) + 1e0), {n})" for d, n in enumerate(_LATTICE))


@query(f"""SELECT key, c0 + 37 * c1 AS id FROM ({sql_rects(f"SELECT key, c0 AS b0, c1 AS b1, c0, c1 FROM ({BOX1_8})", 8, UNIT).replace("SELECT *,", "SELECT key,", 1)}), (SELECT range AS c0 FROM range(37)), (SELECT range AS c1 FROM range(23)) WHERE {_CELL}""")
def q35_lattice_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells of a lattice of 37 x 23 do the boxes meet or touch."""
    boxes = rects(occupied(p1(spark, sf_dir), 8, UNIT), 8, UNIT).drop("c0", "c1")
    return grid.lattice_cover(boxes, _LATTICE, UNIT).select("key", F.col("id").cast("long").alias("id"))


@query(f"""SELECT b.c0 + 16 * b.c1 AS id, p.l0, p.u0, p.l1, p.u1 FROM ({BOX1_8}) b JOIN (SELECT c0, c1,
  0e0 + CAST(c0 AS DOUBLE) / 16 * (1.2e0 - 0e0) AS l0, 0e0 + (CAST(c0 AS DOUBLE) + 1e0) / 16 * (1.2e0 - 0e0) AS u0,
  0e0 + CAST(c1 AS DOUBLE) / 16 * (1.2e0 - 0e0) AS l1, 0e0 + (CAST(c1 AS DOUBLE) + 1e0) / 16 * (1.2e0 - 0e0) AS u1
  FROM (SELECT range AS c0 FROM range(16)), (SELECT range AS c1 FROM range(16))) p USING (c0, c1)""")
def q36_lattice_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = occupied(p1(spark, sf_dir), 8, UNIT).withColumn("id", grid.lattice_id([F.col("c0"), F.col("c1")], [16, 16]))
    return grid.lattice_rects(cells, [16, 16], UNIT).select("id", "l0", "u0", "l1", "u1")


@query(f"""SELECT c0 + 64 * c1 AS id, (c0 + s.range - 1) // 4 + 16 * ((c1 + t.range - 1) // 4) AS patch FROM ({BOX1}), range(3) s, range(3) t
WHERE c0 + s.range >= 1 AND c0 + s.range - 1 < 64 AND c1 + t.range >= 1 AND c1 + t.range - 1 < 64 GROUP BY ALL""")
def q37_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlapping patches of a lattice of 64 x 64 that each occupied cell is in."""
    return grid.patches_of(occupied(p1(spark, sf_dir), 12, UNIT), [64, 64]).select("id", F.col("patch").cast("long").alias("patch"))


@query("""SELECT id, count(*) AS points FROM (SELECT CAST(least(floor(value / 500e0 * 40e0), 39) AS BIGINT) + 40 * CAST(least(floor(CAST(user_id AS DOUBLE) % 30e0 / 30e0 * 25e0), 24) AS BIGINT) AS id
FROM events WHERE value BETWEEN 0 AND 500) GROUP BY id""")
def q38_parameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of a parameter lattice that each event's point lies in, and how many lie there."""
    space = Domain((0.0, 0.0), (500.0, 30.0))
    points = _table(spark, sf_dir, "events").select(F.col("value").alias("x0"), (F.col("user_id").cast("double") % 30.0).alias("x1"))
    return grid.lattice_search(points, [40, 25], space).groupBy("id").agg(F.count(F.lit(1)).alias("points"))


# --- more maps and intervals ------------------------------------------------------------------------------------------


def _numpy_product(x):
    return x / (2.0 - x)


@query(f"SELECT key, fl0, fu0, fl1, fu1 FROM ({sql_product(sql_rects(BOX1, 12, UNIT))})")
def q39_batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point map in numpy at the corners of all boxes of an Arrow batch."""
    return maps.point_batch(_numpy_product).image(rects(occupied(p1(spark, sf_dir), 12, UNIT), 12, UNIT), 2).select("key", "fl0", "fu0", "fl1", "fu1")


@query(f"SELECT key, l0 / (2e0 - l0) AS fl0, u0 / (2e0 - u0) AS fu0, l1 / (2e0 - l1) AS fl1, u1 / (2e0 - u1) AS fu1 FROM ({sql_rects(BOX1_8, 8, UNIT)})")
def q40_scalar_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function of one rectangle, on few boxes."""
    image = maps.scalar_map(lambda r: [x / (2.0 - x) for x in r]).image(rects(occupied(p1(spark, sf_dir), 8, UNIT), 8, UNIT), 2)
    return image.select("key", "fl0", "fu0", "fl1", "fu1")


@query(f"""SELECT key, round((19.6e0 * l0 + 23.68e0 * l1) * exp(u0 * -0.1e0 + u1 * -0.1e0), 9) AS fl0, round((19.6e0 * u0 + 23.68e0 * u1) * exp(l0 * -0.1e0 + l1 * -0.1e0), 9) AS fu0,
  round(l0 * 0.7e0, 9) AS fl1, round(u0 * 0.7e0, 9) AS fu1 FROM ({sql_rects(BOX1, 12, UNIT)})""")
def q41_interval_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A population model of two ages in interval arithmetic."""
    model = maps.IntervalMap(lambda x: [(x[0] * 19.6 + x[1] * 23.68) * iv.exp(x[0] * -0.1 + x[1] * -0.1), x[0] * 0.7])
    image = model.image(rects(occupied(p1(spark, sf_dir), 12, UNIT), 12, UNIT), 2)
    return image.select("key", *[F.round(c, 9).alias(c) for c in ("fl0", "fu0", "fl1", "fu1")])


def _decay(x):
    return -x


_STEP = "(1e0 - 0.1e0 + 0.1e0 * 0.1e0 / 2 - 0.1e0 * 0.1e0 * 0.1e0 / 6 + 0.1e0 * 0.1e0 * 0.1e0 * 0.1e0 / 24)"
_DECAYED = ", ".join(f"round({e}{d} * pow({_STEP}, 10), 9) AS f{e}{d}" for d in range(2) for e in "lu")


@query(f"SELECT key, {_DECAYED} FROM ({sql_rects(BOX1, 12, UNIT)})")
def q42_time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time-1 map of x' = -x by ten Runge-Kutta steps."""
    image = maps.point_batch(maps.rk4(_decay, 1.0, 10)).image(rects(occupied(p1(spark, sf_dir), 12, UNIT), 12, UNIT), 2)
    return image.select("key", *[F.round(c, 9).alias(c) for c in ("fl0", "fu0", "fl1", "fu1")])


_WITHIN = "floor(({b} - {at}) / {period}) >= ceil(({a} - {at}) / {period})"
_TWO_PI, _PI = "6.283185307179586e0", "3.141592653589793e0"


def _sql_cos(a: str, b: str) -> tuple[str, str]:
    low, high = _WITHIN.format(a=a, b=b, at=_PI, period=_TWO_PI), _WITHIN.format(a=a, b=b, at="0e0", period=_TWO_PI)
    return f"CASE WHEN {low} THEN -1e0 ELSE least(cos({a}), cos({b})) END", f"CASE WHEN {high} THEN 1e0 ELSE greatest(cos({a}), cos({b})) END"


_SIN = _sql_cos("(a - 1.5707963267948966e0)", "(b - 1.5707963267948966e0)")
_COS = _sql_cos("a", "b")
_POLE = _WITHIN.format(a="a", b="b", at="1.5707963267948966e0", period=_PI)
_NAMED_SQL = {
    "exp": ("exp(a / 20e0)", "exp(b / 20e0)"), "log": ("ln(a)", "ln(b)"), "cos": _COS, "sin": _SIN,
    "tan": (f"CASE WHEN {_POLE} THEN -1e9 ELSE tan(a) END", f"CASE WHEN {_POLE} THEN 1e9 ELSE tan(b) END"),
    "tanh": ("(exp(a * 0.2e0) - 1) / (exp(a * 0.2e0) + 1)", "(exp(b * 0.2e0) - 1) / (exp(b * 0.2e0) + 1)"),
    "cube": ("a * a * a", "b * b * b"), "root": ("sqrt(a)", "sqrt(b)"), "ratio": ("1e0 / b", "b / a * 1e0"),
    "mid": ("(a + b) / 2", "(b - a) / 2"),
}


@query("WITH h AS (SELECT l_orderkey AS k, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem GROUP BY l_orderkey) SELECT k, "
       + ", ".join(f"round({e}, 6) AS {n}_{side}" for n, ends in _NAMED_SQL.items() if n != "ratio" for e, side in zip(ends, ("lo", "hi"), strict=True))
       + ", round(a / b, 6) AS ratio_lo, round(b / a, 6) AS ratio_hi FROM h")
def q43_interval_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the interval of an order's quantities; ends at a pole are written as 1e9."""
    h = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"))
    x = iv.Interval(F.col("a"), F.col("b"))
    finite = lambda c: F.when(c == float("inf"), 1e9).when(c == float("-inf"), -1e9).otherwise(c)
    tan = iv.tan(x)
    named = {"exp": iv.exp(x * 0.05), "log": iv.log(x), "cos": iv.cos(x), "sin": iv.sin(x), "tan": iv.Interval(finite(tan.lo), finite(tan.hi)), "tanh": iv.tanh(x * 0.1), "cube": iv.power(x, 3), "root": iv.power(x, 0.5), "ratio": x / x, "mid": iv.Interval(x.mid(), x.radius())}
    return h.select("k", *[F.round(c, 6).alias(f"{n}_{e}") for n, i in named.items() for e, c in (("lo", i.lo), ("hi", i.hi))])


# --- cubes, graphs and files as rows ----------------------------------------------------------------------------------

_CUBED = ", ".join(f"greatest(CAST(floor({_n}e0 * (fl{_d} - 0e0) / (1.2e0 - 0e0)) AS BIGINT), 0) AS a{_d}, least(CAST(floor({_n}e0 * (fu{_d} - 0e0) / (1.2e0 - 0e0)) AS BIGINT), {_n - 1}) AS b{_d}" for _d, _n in ((0, 64), (1, 64)))


@query(f"""WITH r AS (SELECT key, {_CUBED} FROM ({sql_product(sql_rects(BOX1_8, 8, UNIT))})), top AS (SELECT c0, c1 FROM ({BOX1}))
SELECT key, c0, c1 FROM r JOIN top ON c0 BETWEEN a0 AND b0 AND c1 BETWEEN a1 AND b1""")
def q44_cubical_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cubes of a complex that images meet: floors of their ends, without slack and without touching from below."""
    image = PRODUCT.image(rects(occupied(p1(spark, sf_dir), 8, UNIT).drop("points"), 8, UNIT).drop("c0", "c1"), 2)
    cubes = occupied(p1(spark, sf_dir), 12, UNIT).select("c0", "c1")
    return cubical.cover(image, [64, 64], UNIT, ["key"], cubes)


@query(f"""SELECT DISTINCT c0, c1 FROM (SELECT {_CUBED} FROM ({sql_product(sql_rects(BOX1_8, 8, UNIT))})), (SELECT range AS c0 FROM range(64)), (SELECT range AS c1 FROM range(64))
WHERE c0 BETWEEN a0 AND b0 AND c1 BETWEEN a1 AND b1""")
def q45_inserted_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complex that is made of all cubes which some image meets."""
    image = PRODUCT.image(rects(occupied(p1(spark, sf_dir), 8, UNIT).drop("points"), 8, UNIT).drop("c0", "c1"), 2)
    return cubical.cover(image, [64, 64], UNIT, []).distinct()


@query(sql_edges1(12, True).join(("SELECT CAST(src AS VARCHAR) || ' ' || count(*) || ' ' || string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS value FROM (", ") GROUP BY src")))
def q46_adjacency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.adjacency_lines(edges1(spark, sf_dir, 12, True))


@query(f"""WITH chart AS (SELECT n_nationkey % 5 AS chart, c_acctbal, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT chart, CAST(least(greatest(floor((c_acctbal + 1000e0) / 12000e0 * 16e0), 0), 15) AS BIGINT) AS c0, CAST(least(greatest(floor(CAST(c_custkey % 997 AS DOUBLE) / 997e0 * 16e0), 0), 15) AS BIGINT) AS c1 FROM chart)
SELECT chart, key, row_number() OVER (ORDER BY chart, key) - 1 AS ge FROM (SELECT DISTINCT chart, {sql_key(["c0", "c1"], 8)} AS key FROM b)""")
def q47_atlas_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of several charts, a chart for each remainder of the nation, numbered chart by chart."""
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    points = rows.select((F.col("n_nationkey") % 5).alias("chart"), F.col("c_acctbal").alias("x0"), (F.col("c_custkey") % 997).cast("double").alias("x1"))
    charts = Domain((-1000.0, 0.0), (11000.0, 997.0))
    cells = points.select("chart", *[c.alias(f"c{d}") for d, c in enumerate(cell_of(8, charts))]).distinct()
    boxes = cells.select("chart", F.lit(8).alias("depth"), key_of([F.col("c0"), F.col("c1")], 8).alias("key"))
    return grid.ranked(boxes, first=["chart"]).select("chart", "key", "ge")


@query(f"""WITH b AS MATERIALIZED (SELECT key, l0, u0, l1, u1 FROM ({sql_rects(sql_occupied(SQL_P2, 8, VALUES), 8, VALUES)}))
SELECT a.key AS key, count(*) AS meets FROM b a JOIN b ON a.l0 <= b.u0 + 1e-8 AND b.l0 <= a.u0 + 1e-8 AND a.l1 <= b.u1 + 1e-8 AND b.l1 <= a.u1 + 1e-8 GROUP BY a.key""")
def q48_rectangles_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes each box meets: candidates by the cells that they touch, then the closed test."""
    boxes = rects(occupied(p2(spark, sf_dir), 8, VALUES), 8, VALUES).select("key", "l0", "u0", "l1", "u1")
    near = covers.cover(boxes.select("key", *[F.col(f"{e}{d}").alias(f"f{e}{d}") for d in range(2) for e in "lu"]), 8, VALUES, ["key"])
    other = boxes.select(F.col("key").alias("dst"), *[F.col(f"{e}{d}").alias(f"o{e}{d}") for d in range(2) for e in "lu"])
    ends = lambda p: [(F.col(f"{p}l{d}"), F.col(f"{p}u{d}")) for d in range(2)]
    return near.join(boxes, "key").join(other, "dst").filter(meet(ends(""), ends("o"))).groupBy("key").agg(F.count(F.lit(1)).alias("meets"))


@query(f"""WITH p AS MATERIALIZED ({SQL_P2}), b AS MATERIALIZED ({sql_rects(sql_occupied(SQL_P2, 12, VALUES), 12, VALUES)})
SELECT key, c.range AS corner, CASE WHEN c.range % 2 = 1 THEN u0 ELSE l0 END AS x0, CASE WHEN c.range >= 2 THEN u1 ELSE l1 END AS x1, l0 + (u0 - l0) / 2 AS m0, l1 + (u1 - l1) / 2 AS m1 FROM b, range(4) c""")
def q49_corners_and_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = rects(occupied(p2(spark, sf_dir), 12, VALUES), 12, VALUES)
    centre = maps.center_point(2)
    corners = sorted(maps.corner_points(2), key=lambda p: ("u1" in str(p[1]), "u0" in str(p[0])))
    points = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("corner"), p[0].alias("x0"), p[1].alias("x1")) for k, p in enumerate(corners)])).alias("p")
    return boxes.select("key", centre[0].alias("m0"), centre[1].alias("m1"), points).select("key", "p.corner", "p.x0", "p.x1", "m0", "m1")


# --- complexes and edge grids -----------------------------------------------------------------------------------------

_X_PARTS = ((6, "l_tax < 0.02"), (8, "l_discount > 0.02"))
_A_PARTS = ((8, "l_quantity > 46"), (10, "l_quantity < 3"))


def _grouped(spark: SparkSession, sf_dir: str, parts: tuple[tuple[int, str], ...]) -> DataFrame:
    """g, depth, key of boxes at several depths, for each group g of lines."""
    rows = _table(spark, sf_dir, "lineitem")
    points = rows.select((F.col("l_linenumber") % 3).alias("g"), "*").select("g", ((F.col("l_quantity") - 1.0) * 1.2 / 49.0).alias("x0"), (F.col("l_extendedprice") * 1.2 / 110000.0).alias("x1"), "l_tax", "l_discount", "l_quantity")
    out = []
    for depth, where in parts:
        cells = points.filter(where).select("g", *[c.alias(f"c{d}") for d, c in enumerate(cell_of(depth, UNIT))]).distinct()
        out.append(cells.select("g", F.lit(depth).alias("depth"), key_of([F.col("c0"), F.col("c1")], depth).alias("key")))
    return reduce(DataFrame.unionByName, out)


def _sql_grouped(parts: tuple[tuple[int, str], ...]) -> str:
    """g and cubes c0, c1 at depth 8."""
    out = []
    for depth, where in parts:
        n = 1 << halvings(depth, 2)[0]
        place = ", ".join(f"CAST(least(greatest(floor((x{d} - 0.0) / 1.2 * {float(n)}e0), 0), {n - 1}) AS BIGINT) AS c{d}" for d in range(2))
        points = SQL_P1.replace("SELECT ", "SELECT l_linenumber % 3 AS g, ", 1)
        cubes = f"SELECT DISTINCT g, {place} FROM ({points} WHERE {where})"
        more = 8 - depth
        out.append(f"SELECT g, c0 * 2 + i.range AS c0, c1 * 2 + j.range AS c1 FROM ({cubes}), range(2) i, range(2) j" if more > 0 else f"SELECT g, c0 >> {-more // 2} AS c0, c1 >> {-more // 2} AS c1 FROM ({cubes})")
    return " UNION ".join(out)


_WRAPPED_FACES = """SELECT DISTINCT g, {e0} AS e0, {e1} AS e1 FROM {cubes} JOIN span USING (g), (VALUES (0), (1), (2)) x(i), (VALUES (0), (1), (2)) y(j)"""
_E = [f"CASE WHEN a{d} = 0 AND b{d} = 15 THEN (2 * (c{d} - a{d}) + {k}) % 32 ELSE 2 * (c{d} - a{d}) + {k} END" for d, k in ((0, "i"), (1, "j"))]


@query(f"""WITH x AS MATERIALIZED ({_sql_grouped(_X_PARTS)}), a AS MATERIALIZED ({_sql_grouped(_A_PARTS)}),
span AS MATERIALIZED (SELECT g, min(c0) AS a0, max(c0) AS b0, min(c1) AS a1, max(c1) AS b1 FROM x GROUP BY g),
face AS ({_WRAPPED_FACES.format(e0=_E[0], e1=_E[1], cubes="x")}), gone AS ({_WRAPPED_FACES.format(e0=_E[0], e1=_E[1], cubes="a")})
SELECT g, e0, e1, CAST(((e0 % 2) + 2) % 2 + ((e1 % 2) + 2) % 2 AS INTEGER) AS dim FROM (SELECT * FROM face EXCEPT SELECT * FROM gone)""")
def q56_relative_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relative cells of boxes of two depths without boxes of two others, on a torus, for each of three groups of lines."""
    found = cubical.relative_complex(_grouped(spark, sf_dir, _X_PARTS), _grouped(spark, sf_dir, _A_PARTS), 8, TORUS, ["g"])
    return found.select("g", *[F.col(f"e{d}").cast("long").alias(f"e{d}") for d in range(2)], F.col("dim").cast("int").alias("dim"))


@query(f"""WITH c AS (SELECT 2 * c0 + 1 AS e0, 2 * c1 + 1 AS e1, points % 5 AS coef FROM ({BOX1_8})),
d AS (SELECT (e0 + 1) % 32 AS e0, e1, coef FROM c UNION ALL SELECT e0 - 1, e1, -coef FROM c UNION ALL SELECT e0, (e1 + 1) % 32, -coef FROM c UNION ALL SELECT e0, e1 - 1, coef FROM c)
SELECT e0, e1, CAST(((sum(coef) % 5) + 5) % 5 AS INTEGER) AS coef FROM d GROUP BY e0, e1 HAVING sum(coef) % 5 <> 0""")
def q57_torus_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary of a chain on a torus of 16 x 16 cubes."""
    boxes = occupied(p1(spark, sf_dir), 8, UNIT)
    chain = boxes.select((F.col("c0") * 2 + 1).alias("e0"), (F.col("c1") * 2 + 1).alias("e1"), (F.col("points") % 5).alias("coef"))
    return cubical.boundary(chain, 2, sizes=[16, 16])


_RANGE = ", ".join(f"CAST(ceil({n}e0 * (l{d} - 0e0) / (1.2e0 - 0e0) - 1e0) AS BIGINT) AS a{d}, CAST(least(floor({n}e0 * (u{d} - 0e0) / (1.2e0 - 0e0) + 1e0), {n + 1}) AS BIGINT) - 1 AS b{d}" for d, n in enumerate(_LATTICE))
_EDGE_ENDS = ", ".join(f"0e0 + CAST(c{d} AS DOUBLE) / {n} * (1.2e0 - 0e0) AS l{d}, 0e0 + (CASE WHEN axis = {d} THEN CAST(c{d} AS DOUBLE) + 1e0 ELSE CAST(c{d} AS DOUBLE) END) / {n} * (1.2e0 - 0e0) AS u{d}" for d, n in enumerate(_LATTICE))


@query(f"""WITH r AS (SELECT key, {_RANGE} FROM ({_SHIFT})),
met AS (SELECT key, axis, p.range AS c0, q.range AS c1, CAST(p.range = a0 AS INTEGER) AS z0, CAST(q.range = a1 AS INTEGER) AS z1 FROM r, range(38) p, range(24) q, (VALUES (0), (1)) x(axis)
  WHERE p.range BETWEEN greatest(a0, 0) AND b0 AND q.range BETWEEN greatest(a1, 0) AND b1)
SELECT key, CASE WHEN axis = 0 THEN c0 + 37 * c1 ELSE {37 * 24} + c0 + 38 * c1 END AS id, axis, {_EDGE_ENDS} FROM met
WHERE (z0 + z1 = 0 OR (z0 + z1 = 1 AND CASE WHEN axis = 0 THEN z0 ELSE z1 END = 1)) AND CASE WHEN axis = 0 THEN c0 < 37 ELSE c1 < 23 END""")
def q58_edge_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a lattice of 37 x 23 cells that boxes meet: their numbers, and from these their places."""
    boxes = rects(occupied(p1(spark, sf_dir), 8, UNIT), 8, UNIT).select("key", "l0", "u0", "l1", "u1")
    ids = grid.edge_cover(boxes, _LATTICE, UNIT).select("key", grid.edge_id(_LATTICE).alias("id"))
    return grid.edge_rects(ids.withColumns(grid.edge_place(_LATTICE)), _LATTICE, UNIT).select("key", "id", "axis", "l0", "u0", "l1", "u1")


@query(f"""WITH f AS ({_FACES}) SELECT e0, e1, {', '.join(f"0e0 + (1.2e0 / 64e0) * CAST(e{d} >> 1 AS DOUBLE) AS l{d}, 0e0 + (1.2e0 / 64e0) * CAST(e{d} >> 1 AS DOUBLE) + CASE WHEN e{d} % 2 = 1 THEN 1.2e0 / 64e0 ELSE 0e0 END AS u{d}" for d in range(2))} FROM f""")
def q59_cell_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cubical.cells(occupied(p1(spark, sf_dir), 12, UNIT), 2)
    return cubical.geometry(cells, [64, 64], UNIT).select("e0", "e1", "l0", "u0", "l1", "u1")


_STEP64 = "(1.2e0 / 64e0)"
_AROUND = ", ".join(f"greatest(CAST(ceil(64e0 * (fl{d} - 0e0) / (1.2e0 - 0e0)) AS BIGINT) - 1, 0) AS a{d}, least(CAST(floor(64e0 * (fu{d} - 0e0) / (1.2e0 - 0e0)) AS BIGINT), 63) AS b{d}" for d in range(2))
_PRISM64 = f"""SELECT src, c0, c1 FROM (SELECT *, abs(a00 * a11 - a01 * a10) AS half, {', '.join(f'0e0 + CAST(c{d} AS DOUBLE) * {_STEP64} AS l{d}, 0e0 + CAST(c{d} + 1 AS DOUBLE) * {_STEP64} AS u{d}' for d in range(2))}
  FROM (SELECT src, m0, m1, a00, a01, a10, a11, {_AROUND} FROM ({_BOUNDED})), (SELECT range AS c0 FROM range(64)), (SELECT range AS c1 FROM range(64)) WHERE c0 BETWEEN a0 AND b0 AND c1 BETWEEN a1 AND b1) WHERE {_FACES_APART}"""
_RECT64 = f"SELECT key AS src, c0, c1 FROM (SELECT key, {_CUBED.replace('fl0', 'l0').replace('fl1', 'l1').replace('fu', 'u')} FROM ({_SHIFT})), (SELECT range AS c0 FROM range(64)), (SELECT range AS c1 FROM range(64)) WHERE c0 BETWEEN a0 AND b0 AND c1 BETWEEN a1 AND b1"


@query(f"""WITH p AS MATERIALIZED ({_PRISM64}), r AS MATERIALIZED ({_RECT64}), top AS (SELECT c0, c1 FROM ({BOX1}))
SELECT 'prism' AS kind, src, c0, c1 FROM p JOIN top USING (c0, c1) UNION ALL SELECT 'list', src, c0, c1 FROM (SELECT * FROM p UNION SELECT * FROM r) JOIN top USING (c0, c1)
UNION ALL SELECT 'pair', src, c0, c1 FROM (SELECT * FROM p INTERSECT SELECT * FROM r) JOIN top USING (c0, c1)""")
def q60_cubical_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes of a complex that prisms meet; of lists of a prism and a rectangle, those that either meets; of pairs, those that both meet."""
    cubes = occupied(p1(spark, sf_dir), 12, UNIT).select("c0", "c1")
    boxes = rects(occupied(p1(spark, sf_dir), 8, UNIT).drop("points"), 8, UNIT).drop("c0", "c1").withColumnRenamed("key", "src")
    prisms = cubical.prism_cover(boxes.withColumns(_skew()), [64, 64], UNIT, ["src"], cubes)
    plain = cubical.cover(boxes.select("src", *[F.col(f"{e}{d}").alias(f"f{e}{d}") for d in range(2) for e in "lu"]), [64, 64], UNIT, ["src"], cubes)
    kinds = {"prism": prisms, "list": covers.union_cover([prisms, plain]), "pair": covers.intersection_cover([prisms, plain])}
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "src", "c0", "c1") for kind, df in kinds.items()])


@query(f"""WITH b AS MATERIALIZED (SELECT key, l0, u0, l1, u1 FROM ({sql_rects(sql_occupied(SQL_P2, 8, VALUES), 8, VALUES)})),
moved AS (SELECT key, {', '.join(f'(l{d} + u{d}) / 2e0 * 0.5e0 + l{d} AS p{d}, (l{d} + u{d}) / 2e0 * 0.5e0 + u{d} AS q{d}' for d in range(2))} FROM b)
SELECT b.key, p0 AS l0, q0 AS u0, p1 AS l1, q1 AS u1, CAST(b.l0 + 1e-12 AS FLOAT) = CAST(b.l0 AS FLOAT) AND CAST(b.u0 AS FLOAT) = CAST(q0 AS FLOAT) AS same FROM b JOIN moved USING (key)""")
def q61_rect_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each box's centre added to the box; equality in single precision."""
    boxes = rects(occupied(p2(spark, sf_dir), 8, VALUES), 8, VALUES).select("key", *[F.col(x).alias(x) for x in rect_columns(2)])
    held = boxes.withColumns({f"o{x}": F.col(x) for x in rect_columns(2)})
    moved = held.withColumns(centroid(2)).withColumns(scaled(0.5, 2)).withColumns(added(2))
    nearly = moved.withColumns({"__a": F.col("ol0") + 1e-12, "__b": F.col("u0")})
    same = (F.col("__a").cast("float") == F.col("ol0").cast("float")) & (F.col("ou0").cast("float") == F.col("__b").cast("float"))
    return nearly.select("key", *rect_columns(2), same.alias("same"))


# --- whole Morse graphs -----------------------------------------------------------------------------------------------


@query()
def q26_morse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Morse graph of the events' sampled map: its vertices and reduced edges (v null: a vertex)."""
    model = morse.Model(VALUES, maps.DataMap(p2(spark, sf_dir), VALUES), 8, 10, 6)
    g = morse.morse_graph(spark, model)
    sets = g.vertices.select(F.col("v").cast("long").alias("u"), F.lit(None).cast("long").alias("v"), "size", "least")
    none = F.lit(None).cast("long")
    return sets.unionByName(g.edges().select(F.col("u").cast("long"), F.col("v").cast("long"), none.alias("size"), none.alias("least")))

# A refinement of two levels: all boxes at depth 8, then the halves of those that recur. The map is known from P4's points and their images.


SQL_P5 = f"SELECT x0, x1, x0 / (2e0 - x0) AS y0, x1 / (2e0 - x1) AS y1 FROM ({SQL_P4})"


def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4(spark, sf_dir).withColumns({f"y{d}": y for d, y in enumerate(product_map([F.col("x0"), F.col("x1")]))})


def _sql_interpolated(boxes: str) -> str:
    """key, fl0 ... of boxes (key, l0, u0 ...): hulls of P5's values, boxes doubled until they hold some."""
    return f"""(WITH RECURSIVE tried(turn, key, l0, u0, l1, u1, hit) AS (
  SELECT 0, key, l0, u0, l1, u1, EXISTS (SELECT 1 FROM p WHERE {_INSIDE}) FROM ({boxes})
  UNION ALL SELECT turn + 1, key, l0, u0, l1, u1, EXISTS (SELECT 1 FROM p WHERE {_INSIDE}) FROM (SELECT turn, key, {_GROWN} FROM tried WHERE NOT hit AND turn < 20))
SELECT key AS src, min(y0) AS fl0, max(y0) AS fu0, min(y1) AS fl1, max(y1) AS fu1 FROM (SELECT * FROM tried WHERE hit) t JOIN p ON {_INSIDE} GROUP BY key)"""


_B8 = sql_rects("SELECT key, c0, c1 FROM b8", 8, UNIT)
_B9 = sql_rects("SELECT key, c0, c1 FROM b9", 9, UNIT)


def sql_refined(points: str, further: str = "", kept: str = "members9") -> str:
    """Tables of a refinement from depth 8 to 9 for a sampled map; further: tables of deeper levels; kept: those members at depth 9 whose sets persist."""
    return f"""WITH RECURSIVE p AS MATERIALIZED ({points}),
b8 AS MATERIALIZED (SELECT {sql_key(['a.range', 'b.range'], 8)} AS key, a.range AS c0, b.range AS c1 FROM range(16) a, range(16) b),
e8 AS MATERIALIZED ({sql_cover(f"SELECT * FROM {_sql_interpolated(f'SELECT key, l0, u0, l1, u1 FROM ({_B8})')}", 8, UNIT, "src")}),
closure8(a, b) AS (SELECT src, dst FROM e8 UNION SELECT a, dst FROM closure8 JOIN e8 ON b = src),
members8 AS MATERIALIZED (SELECT x.a AS key, min(x.b) AS comp FROM closure8 x JOIN closure8 y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
b9 AS MATERIALIZED (SELECT comp AS node, members8.key * 2 + h.range AS key, c0 * 2 + h.range AS c0, c1 FROM members8 JOIN b8 USING (key), range(2) h),
all9 AS MATERIALIZED ({sql_cover(f"SELECT * FROM {_sql_interpolated(f'SELECT key, l0, u0, l1, u1 FROM ({_B9})')}", 9, UNIT, "src")}),
e9 AS MATERIALIZED (SELECT s.node, src, dst FROM all9 JOIN b9 s ON src = s.key JOIN b9 d ON dst = d.key AND s.node = d.node),
closure9(node, a, b) AS (SELECT node, src, dst FROM e9 UNION SELECT closure9.node, a, dst FROM closure9 JOIN e9 ON b = src AND closure9.node = e9.node),
members9 AS MATERIALIZED (SELECT x.node, x.a AS key, min(x.b) AS comp FROM closure9 x JOIN closure9 y ON x.a = y.b AND x.b = y.a AND x.node = y.node GROUP BY x.node, x.a),
{further}sets AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(key)) - 1 AS v, node, comp, count(*) AS size, min(key) AS least FROM {kept} GROUP BY node, comp),
pairs AS MATERIALIZED (
  SELECT s.v AS u, t.v AS v FROM sets s JOIN sets t ON s.node = t.node AND s.v <> t.v JOIN closure9 c ON c.node = s.node AND c.a = s.least AND c.b = t.least
  UNION SELECT s.v, t.v FROM sets s JOIN sets t ON s.node <> t.node JOIN closure8 c ON c.a = s.node AND c.b = t.node),
reduced AS (SELECT * FROM pairs EXCEPT SELECT x.u, y.v FROM pairs x JOIN pairs y ON x.v = y.u)
"""


SQL_REFINED = sql_refined(SQL_P5)


def refined(spark: SparkSession, sf_dir: str) -> morse.MorseGraph:
    return morse.morse_graph(spark, morse.Model(UNIT, maps.DataMap(p5(spark, sf_dir), UNIT), 9, 9, 8))


@query(SQL_REFINED + "SELECT v AS u, CAST(NULL AS BIGINT) AS v, size, least FROM sets UNION ALL SELECT u, v, NULL, NULL FROM reduced")
def q62_morse_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Morse graph of a sampled map by two levels: its vertices and reduced edges (v null: a vertex)."""
    g = refined(spark, sf_dir)
    none = F.lit(None).cast("long")
    sets = g.vertices.select(F.col("v").cast("long").alias("u"), none.alias("v"), F.col("size").cast("long").alias("size"), "least")
    return sets.unionByName(g.edges().select(F.col("u").cast("long"), F.col("v").cast("long"), none.alias("size"), none.alias("least")))


@query(SQL_REFINED + """, leaf AS (SELECT 9 AS depth, key FROM b9 UNION ALL SELECT 8, key FROM b8 WHERE key NOT IN (SELECT key FROM members8))
SELECT depth, key, row_number() OVER (ORDER BY key << (62 - depth)) - 1 AS ge, v FROM leaf LEFT JOIN (SELECT 9 AS depth, members9.key, v FROM members9 JOIN sets USING (node, comp)) USING (depth, key)""")
def q63_phase_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final grid of the same refinement, its ranks, and the set that a box is in."""
    g = refined(spark, sf_dir)
    named = g.morse_sets().select("ge", F.col("v").cast("long").alias("v"))
    return g.phase.join(named, "ge", "left").select("depth", "key", "ge", "v")



@query(SQL_RECURRENCE + f"""SELECT l0, l1, u0, u1, CAST(comp AS DOUBLE) AS v FROM members JOIN ({_SHIFT}) USING (key)""")
def q28_morse_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = recurrent1(spark, sf_dir)[1].select("key", F.col("comp").alias("v"))
    return files.box_rows(with_rects(members, 8, UNIT), 2)


@query(SQL_RECURRENCE + """, image AS (SELECT DISTINCT comp, dst AS key FROM e JOIN members ON src = members.key)
SELECT i.comp, i.key, m.key IS NULL AS exit FROM image i LEFT JOIN members m ON i.comp = m.comp AND i.key = m.key""")
def q29_index_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, members = recurrent1(spark, sf_dir)
    return graph.index_pair(edges, members).select("comp", "key", "exit")


@query(SQL_ORDER + """SELECT u || ' -> ' || v || ';' AS line FROM reduced
UNION ALL SELECT n_nationkey || ' [label="' || n_name || '", style=filled, fillcolor="' || '0.' || lpad(CAST(n_nationkey * 382 % 1000 AS VARCHAR), 3, '0') || ' 0.500 0.900' || '"];' FROM nation""")
def q30_dot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v"), F.col("n_name").alias("label"))
    return files.dot_lines(vertices, graph.transitive_reduction(nations_order(spark, sf_dir)))


@query("""SELECT n_nationkey AS v, n_name || coalesce((SELECT string_agg('\\n' || s, '' ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)), '') AS label FROM nation""")
def q50_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as vertices, the segments of their rich customers as notes, in the labels of a DOT text."""
    vertices = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v"), "n_name")
    notes = _table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("v"), F.col("c_mktsegment").alias("note"))
    return files.labels(graph.annotated(vertices, notes), "n_name").select("v", "label")


@query(SQL_RECURRENCE + """, image AS (SELECT DISTINCT comp, dst AS key FROM e JOIN members ON src = members.key),
pair AS (SELECT i.comp, i.key, m.key IS NULL AS exit FROM image i LEFT JOIN members m ON i.comp = m.comp AND i.key = m.key),
cube AS (SELECT comp, exit, c0, c1 FROM pair JOIN (""" + BOX1_8 + """) USING (key)),
face AS (SELECT DISTINCT comp, 2 * c0 + i AS e0, 2 * c1 + j AS e1 FROM cube, (VALUES (0), (1), (2)) x(i), (VALUES (0), (1), (2)) y(j)),
gone AS (SELECT DISTINCT comp, 2 * c0 + i AS e0, 2 * c1 + j AS e1 FROM cube, (VALUES (0), (1), (2)) x(i), (VALUES (0), (1), (2)) y(j) WHERE exit)
SELECT comp, CAST(sum(CASE WHEN (e0 + e1) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS euler FROM (SELECT * FROM face EXCEPT SELECT * FROM gone) GROUP BY comp""")
def q31_relative_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Euler characteristic of each set's index pair."""
    edges, members = recurrent1(spark, sf_dir)
    pair = with_cells(graph.index_pair(edges, members), 8, 2)
    return cubical.euler_characteristic(cubical.relative(pair, 2, ["comp"]), ["comp"])

@query(SQL_REFINED + """, leaf AS (SELECT key FROM b9 UNION ALL SELECT key FROM b8 WHERE key NOT IN (SELECT key FROM members8))
SELECT (SELECT count(*) FROM leaf) AS boxes, (SELECT count(*) FROM sets) AS sets, (SELECT count(*) FROM members9) AS boxes_in_sets, (SELECT count(*) FROM pairs) AS pairs""")
def q64_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.statistics(refined(spark, sf_dir), 0.0).drop("seconds")


@query(SQL_RECURRENCE + f"""SELECT l0, u0, l1, u1, comp AS v FROM members JOIN ({_SHIFT}) USING (key)""")
def q65_sets_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morse sets written as text and read again."""
    members = recurrent1(spark, sf_dir)[1].select("key", F.col("comp").alias("v"))
    path = f"{shared_dir(spark)}/sets-{uuid.uuid4().hex}"
    files.write_sets(with_rects(members, 8, UNIT), path, 2)
    return files.read_sets(spark, path, 2).select("l0", "u0", "l1", "u1", "v")


@query(f"SELECT key, true AS inside, true AS again FROM ({BOX1})")
def q66_random_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of random points of a box lies in it, and the same points come again."""
    boxes = rects(occupied(p1(spark, sf_dir), 12, UNIT), 12, UNIT)
    drawn = maps.ExpressionMap(lambda x: x, "random", points=7, seed=3).image(boxes, 2)
    once = F.struct(*[f"f{e}{d}" for d in range(2) for e in "lu"])
    held = drawn.withColumn("__once", once)
    twice = maps.ExpressionMap(lambda x: x, "random", points=7, seed=3).image(held, 2)
    inside = reduce(Column.__and__, [(F.col(f"l{d}") <= F.col(f"fl{d}")) & (F.col(f"fl{d}") < F.col(f"fu{d}")) & (F.col(f"fu{d}") <= F.col(f"u{d}")) for d in range(2)])
    return twice.select("key", inside.alias("inside"), (F.col("__once") == once).alias("again"))


@query("""WITH h AS (SELECT l_orderkey AS k, min(l_tax) + 0.5e0 AS a, max(l_tax) + 0.5e0 + max(l_discount) AS b FROM lineitem GROUP BY l_orderkey)
SELECT k, round(1e0 / tan(b), 6) AS lo, round(1e0 / tan(a), 6) AS hi FROM h""")
def q67_interval_cot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cotangent of intervals between two of its poles."""
    h = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.min("l_tax") + 0.5).alias("a"), (F.max("l_tax") + 0.5 + F.max("l_discount")).alias("b"))
    x = iv.cot(iv.Interval(F.col("a"), F.col("b")))
    return h.select("k", F.round(x.lo, 6).alias("lo"), F.round(x.hi, 6).alias("hi"))


@query(f"SELECT 'cube' AS kind, c0 - (SELECT min(c0) FROM ({BOX1})) AS a, c1 - (SELECT min(c1) FROM ({BOX1})) AS b FROM ({BOX1}) UNION ALL SELECT 'tile', key, key // 4 FROM ({BOX1})")
def q68_cubes_and_tiles_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes and tiles written as lines and read again; cubes count from the least corner."""
    boxes, folder = occupied(p1(spark, sf_dir), 12, UNIT), f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    boxes.select(F.format_string("(%d,%d)", "c0", "c1")).write.text(f"{folder}/cubes")
    boxes.select(F.format_string("%d %d", F.col("key"), F.shiftright("key", 2))).write.text(f"{folder}/tiles")
    cubes = files.cubes_from_text(spark, f"{folder}/cubes", 2).select(F.lit("cube").alias("kind"), F.col("c0").alias("a"), F.col("c1").alias("b"))
    return cubes.unionByName(files.read_tiles(spark, f"{folder}/tiles").select(F.lit("tile").alias("kind"), F.col("index").alias("a"), F.col("tile").alias("b")))

@query(f"SELECT x0, x1, y0, y1 FROM ({SQL_P2})")
def q69_samples_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as lines of numbers and read again."""
    path = f"{shared_dir(spark)}/samples-{uuid.uuid4().hex}"
    p2(spark, sf_dir).select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x0", "x1", "y0", "y1")])).write.text(path)
    return files.read_samples(spark, path, 2)


@query(SQL_REFINED + "SELECT 'set' AS kind, v, size AS a, least AS b FROM sets UNION ALL SELECT 'pair', NULL, u, v FROM pairs")
def q70_saved_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Morse graph saved as tables and loaded again: its sets and all pairs of their order."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    files.save(refined(spark, sf_dir), path)
    g = files.load(spark, path)
    as_long = lambda *names: [F.col(x).cast("long").alias(y) for x, y in names]
    sets = g.vertices.select(F.lit("set").alias("kind"), *as_long(("v", "v"), ("size", "a"), ("least", "b")))
    return sets.unionByName(g.edges_unreduced.select(F.lit("pair").alias("kind"), F.lit(None).cast("long").alias("v"), *as_long(("u", "a"), ("v", "b"))))


_ROLES = "SELECT v, v NOT IN (SELECT u FROM pairs) AS attractor, v NOT IN (SELECT v FROM pairs) AS repeller FROM sets"


@query(SQL_REFINED + f"""SELECT v, attractor, repeller, l0, u0, l1, u1 FROM ({_ROLES}) JOIN sets USING (v) JOIN members9 USING (node, comp)
JOIN ({sql_rects("SELECT node, key, c0, c1 FROM b9", 9, UNIT)}) r ON r.node = members9.node AND r.key = members9.key""")
def q71_boxes_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of each set of the refinement, and whether it is an attractor or a repeller."""
    g = refined(spark, sf_dir)
    role = lambda df, name: df.select("v", F.lit(True).alias(name))
    out = g.boxes().join(role(g.attractors(), "attractor"), "v", "left").join(role(g.repellers(), "repeller"), "v", "left")
    no = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return out.select(F.col("v").cast("long").alias("v"), no("attractor"), no("repeller"), *rect_columns(2))


_FACES8 = f"SELECT DISTINCT 2 * c0 + i AS e0, 2 * c1 + j AS e1 FROM ({BOX1_8}), (VALUES (0), (1), (2)) x(i), (VALUES (0), (1), (2)) y(j)"


@query(f"""WITH f AS MATERIALIZED ({_FACES8}), c AS (SELECT e0, e1, (e0 // 2 + 2 * (e1 // 2)) % 5 AS coef FROM f WHERE e0 % 2 = 0 AND e1 % 2 = 0),
d AS (SELECT f.e0, f.e1, b.coef - a.coef AS coef FROM f JOIN c a ON a.e0 = f.e0 - f.e0 % 2 AND a.e1 = f.e1 - f.e1 % 2 JOIN c b ON b.e0 = f.e0 + f.e0 % 2 AND b.e1 = f.e1 + f.e1 % 2 WHERE f.e0 % 2 + f.e1 % 2 = 1)
SELECT e0, e1, CAST((coef % 5 + 5) % 5 AS INTEGER) AS coef FROM d WHERE coef % 5 <> 0""")
def q72_coboundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coboundary of a chain on the corners of boxes."""
    faces = cubical.cells(occupied(p1(spark, sf_dir), 8, UNIT), 2)
    corners = faces.filter("dim = 0").select("e0", "e1", F.expr("(e0 div 2 + 2 * (e1 div 2)) % 5").alias("coef"))
    return cubical.coboundary(corners.filter("coef != 0"), faces.drop("dim"), 2)


#: A level more: the sets of depth 9 without recurrent boxes at depth 10 aren't sets, and their boxes of depth 10 are in the final grid. The map pulls the first axis
#: together and drifts along the second, ever slower: fast drift recurs in wide boxes alone.
SQL_DRIFT = f"SELECT x0, x1, x0 * 0.5e0 + 0.3e0 AS y0, x1 + (1.2e0 - x1) * 0.08e0 AS y1 FROM ({SQL_P4})"
_B10 = sql_rects("SELECT DISTINCT key, c0, c1 FROM b10", 10, UNIT)
_DEEPER = f"""b10 AS MATERIALIZED (SELECT comp AS node, key * 2 + h.range AS key, c0, c1 * 2 + h.range AS c1 FROM members9 JOIN b9 USING (node, key), range(2) h),
all10 AS MATERIALIZED ({sql_cover(f"SELECT * FROM {_sql_interpolated(f'SELECT key, l0, u0, l1, u1 FROM ({_B10})')}", 10, UNIT, "src")}),
e10 AS MATERIALIZED (SELECT s.node, src, dst FROM all10 JOIN b10 s ON src = s.key JOIN b10 d ON dst = d.key AND s.node = d.node),
closure10(node, a, b) AS (SELECT node, src, dst FROM e10 UNION SELECT closure10.node, a, dst FROM closure10 JOIN e10 ON b = src AND closure10.node = e10.node),
alive AS MATERIALIZED (SELECT DISTINCT node AS comp FROM closure10 WHERE a = b),
kept AS MATERIALIZED (SELECT * FROM members9 WHERE comp IN (SELECT comp FROM alive)),
"""
SQL_PERSISTENT = sql_refined(SQL_DRIFT, _DEEPER, "kept")


@query(SQL_PERSISTENT + """, leaf AS (SELECT 10 AS depth, key FROM b10 WHERE node NOT IN (SELECT comp FROM alive)
UNION ALL SELECT 9, key FROM b9 WHERE key NOT IN (SELECT key FROM members9 WHERE comp NOT IN (SELECT comp FROM alive)) UNION ALL SELECT 8, key FROM b8 WHERE key NOT IN (SELECT key FROM members8))
SELECT 'set' AS kind, v AS a, size AS b, least AS c FROM sets UNION ALL SELECT 'edge', u, v, NULL FROM reduced
UNION ALL SELECT 'leaf', depth, key, v FROM leaf LEFT JOIN (SELECT 9 AS depth, kept.key, v FROM kept JOIN sets USING (node, comp)) USING (depth, key)""")
def q79_persistent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Morse graph of a sampled map by three levels, the last of which tells which sets persist: sets, reduced edges, and the final grid with the sets of its boxes."""
    drift = p4(spark, sf_dir).withColumns({"y0": F.col("x0") * 0.5 + 0.3, "y1": F.col("x1") + (1.2 - F.col("x1")) * 0.08})
    g = morse.morse_graph(spark, morse.Model(UNIT, maps.DataMap(drift, UNIT), 9, 10, 8))
    row = lambda df, kind, *abc: df.select(F.lit(kind).alias("kind"), *[F.expr(x).cast("long").alias(n) for x, n in zip(abc, "abc", strict=True)])
    leaves = g.phase.join(g.morse_sets().select("ge", "v"), "ge", "left")
    return row(g.vertices, "set", "v", "size", "least").unionByName(row(g.edges(), "edge", "u", "v", "null")).unionByName(row(leaves, "leaf", "depth", "key", "v"))


#: The squares of boxes that hold more points than the average.
_CROWDED = f"SELECT 2 * c0 + 1 AS e0, 2 * c1 + 1 AS e1 FROM ({BOX1_8}) WHERE points > (SELECT avg(points) FROM ({BOX1_8}))"
_NEAR = "SELECT DISTINCT {e}0 + i AS e0, {e}1 + j AS e1 FROM {cells} c, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j) WHERE (({e}0 % 2 = {odd}) OR i = 0) AND (({e}1 % 2 = {odd}) OR j = 0)"


def crowded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The faces of all of P1's boxes at depth 8, and the squares of those that hold more points than the average."""
    boxes = cut(occupied(p1(spark, sf_dir), 8, UNIT))
    mean = boxes.agg(F.avg("points").alias("mean"))
    some = boxes.join(F.broadcast(mean), F.col("points") > F.col("mean"))
    return cubical.cells(boxes, 2), some.select((F.col("c0") * 2 + 1).alias("e0"), (F.col("c1") * 2 + 1).alias("e1"))


@query(f"""WITH f AS MATERIALIZED ({_FACES8}), s AS MATERIALIZED ({_CROWDED}), c AS MATERIALIZED ({_NEAR.format(e="e", cells="s", odd=1)}), t AS ({_NEAR.format(e="e", cells="c", odd=0)})
SELECT 'closure' AS kind, e0, e1, e0 % 2 + e1 % 2 AS dim FROM c UNION ALL SELECT 'star', e0, e1, e0 % 2 + e1 % 2 FROM t JOIN f USING (e0, e1)""")
def q73_closure_and_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of the squares of crowded boxes, and its star among the faces of all boxes."""
    faces, some = crowded(spark, sf_dir)
    closed = cubical.closure(some, 2)
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "e0", "e1", F.col("dim").cast("long").alias("dim"))
    return kind(closed, "closure").unionByName(kind(cubical.star(closed, faces, 2), "star"))


@query(f"""WITH s AS ({_CROWDED}), c AS MATERIALIZED ({_NEAR.format(e="e", cells="s", odd=1)}),
n AS MATERIALIZED (SELECT e0, e1, e0 % 2 + e1 % 2 AS dim, ((e1 // 2 + 1) * 18 + e0 // 2 + 1) * 4 + 2 * (e1 % 2) + e0 % 2 AS address FROM c),
i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY address) - 1 AS nth FROM n)
SELECT b.dim, a.nth AS row, b.nth AS column, CAST(((CASE WHEN b.e0 <> a.e0 THEN b.e0 - a.e0 ELSE (b.e1 - a.e1) * CASE WHEN b.e0 % 2 = 1 THEN -1 ELSE 1 END END) * -1 + 5) % 5 AS INTEGER) AS value
FROM i b JOIN i a ON a.dim = b.dim - 1 AND abs(a.e0 - b.e0) + abs(a.e1 - b.e1) = 1""")
def q74_boundary_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary maps, modulo 5, of the subcomplex of crowded boxes, as entries of sparse matrices."""
    found = cubical.boundary_matrix(cubical.closure(crowded(spark, sf_dir)[1], 2), [16, 16])
    return found.select(F.col("dim").cast("long").alias("dim"), "row", "column", "value")


@query(f"""WITH f AS MATERIALIZED ({_FACES8}), s AS MATERIALIZED ({_CROWDED}), c AS ({_NEAR.format(e="e", cells="s", odd=1)}),
b AS (SELECT 2 * c0 + 1 AS e0, 2 * c1 + 1 AS e1, points % 5 AS coef FROM ({BOX1_8})),
d AS (SELECT e0 + 1 AS e0, e1, coef FROM b UNION ALL SELECT e0 - 1, e1, -coef FROM b UNION ALL SELECT e0, e1 + 1, -coef FROM b UNION ALL SELECT e0, e1 - 1, coef FROM b),
t AS (SELECT e0, e1, ((sum(coef) % 5) + 5) % 5 AS coef FROM d GROUP BY e0, e1)
SELECT ((e1 // 2 + 1) * 18 + e0 // 2 + 1) * 4 + 2 * (e1 % 2) + e0 % 2 AS address, CAST(coef AS INTEGER) AS coef FROM t JOIN c USING (e0, e1) WHERE coef <> 0""")
def q75_projected_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary of a chain on all boxes, projected to the subcomplex of crowded ones, by the addresses of its cells."""
    some = cubical.closure(crowded(spark, sf_dir)[1], 2)
    chain = occupied(p1(spark, sf_dir), 8, UNIT).select((F.col("c0") * 2 + 1).alias("e0"), (F.col("c1") * 2 + 1).alias("e1"), (F.col("points") % 5).alias("coef"))
    return cubical.projected(cubical.boundary(chain, 2), some, 2).select(cubical.address([16, 16]).alias("address"), "coef")


@query(f"""WITH b AS MATERIALIZED (SELECT c0, c1, c0 + 64 * c1 AS id FROM ({BOX1})), p AS (SELECT a.id AS u, b.id AS v FROM b a JOIN b ON abs(a.c0 - b.c0) <= 1 AND abs(a.c1 - b.c1) <= 1 AND a.id <> b.id)
SELECT u, v FROM p WHERE u < v UNION ALL SELECT id, NULL FROM b WHERE id NOT IN (SELECT u FROM p)""")
def q76_pair_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each two neighbours among the occupied cells of a lattice of 64 x 64."""
    return grid.pair_patches(occupied(p1(spark, sf_dir), 12, UNIT), [64, 64])


_PRIME = 101


@query(f"""WITH t AS (SELECT DISTINCT l_partkey AS x, -l_suppkey AS y FROM lineitem), r AS (SELECT x, y, x % {_PRIME} AS a, (y % {_PRIME} + {_PRIME}) % {_PRIME} AS b FROM t),
i AS (SELECT p.range AS b, q.range AS inv FROM range({_PRIME}) p, range({_PRIME}) q WHERE (p.range * q.range) % {_PRIME} = 1)
SELECT x, y, (a + b) % {_PRIME} AS plus, (a - b + {_PRIME}) % {_PRIME} AS minus, (a * b) % {_PRIME} AS times, inv AS inverse, (a * inv) % {_PRIME} AS ratio,
  CASE WHEN 2 * a > {_PRIME} THEN a - {_PRIME} ELSE a END AS balanced FROM r LEFT JOIN i USING (b)""")
def q77_field_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, products and quotients modulo 101 of the keys of all order lines."""
    x, y = F.col("x"), F.col("y")
    pairs = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("x"), (-F.col("l_suppkey")).cast("long").alias("y")).distinct()
    return pairs.select("x", "y", fields.plus(x, y, _PRIME).alias("plus"), fields.minus(x, y, _PRIME).alias("minus"), fields.times(x, y, _PRIME).alias("times"), fields.inverse(y, _PRIME).alias("inverse"),
                        fields.over(x, y, _PRIME).alias("ratio"), fields.balanced(x, _PRIME).alias("balanced"))


@query(SQL_RECURRENCE.replace(f"e AS MATERIALIZED ({sql_edges1(8, True)})", f"""g AS MATERIALIZED ({sql_edges1(8, True)}),
e AS MATERIALIZED (SELECT src, dst FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE dst = src + 1)""") + "SELECT comp, key FROM members")
def q78_edited_digraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrent components of a map graph whose loops are taken away and whose edges to the next box get one back."""
    edges = cut(edges1(spark, sf_dir, 8, True).withColumn("node", F.lit(0).cast("long")))
    back = edges.filter("dst = src + 1").select("node", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.components(graph.edited(edges, back, edges.filter("src = dst"))).select("comp", "key")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q10_morse_sets(spark, sf_dir)
