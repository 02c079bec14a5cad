"""Operators of the engine: published values, brute force, and properties."""

from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dynspark.functions import fields
from dynspark.functions import intervals as iv
from dynspark.functions.boxes import Domain, with_rects
from dynspark.functions.keys import coordinates, halvings, key_of
from dynspark.operators import cells as cubical
from dynspark.operators import cover as covers
from dynspark.operators import graph, grid, maps
from dynspark.plans import morse
from dynspark.sources import files

UNIT = Domain((0, 0), (1.2, 1.2))
PRODUCT = maps.ExpressionMap(lambda x: [c / (2.0 - c) for c in x])


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("depth,dim", [(0, 2), (5, 2), (7, 3), (4, 1)])
def test_keys_and_coordinates_are_inverse(spark, depth, dim):
    df = grid.uniform(spark, depth)
    back = df.select("key", key_of(coordinates(F.col("key"), depth, dim), depth).alias("again"), *[c.alias(f"c{d}") for d, c in enumerate(coordinates(F.col("key"), depth, dim))])
    got = back.collect()
    assert all(r["key"] == r["again"] for r in got)
    assert len({r[2:] for r in got}) == 1 << depth
    assert all(0 <= r[f"c{d}"] < 1 << halvings(depth, dim)[d] for r in got for d in range(dim))


def test_boxes_tile_the_domain(spark):
    got = with_rects(grid.uniform(spark, 6), 6, UNIT).collect()
    assert abs(sum((r["u0"] - r["l0"]) * (r["u1"] - r["l1"]) for r in got) - 1.44) < 1e-12
    assert min(r["l0"] for r in got) == 0.0 and max(r["u1"] for r in got) == 1.2


def test_cover_is_the_closed_intersection(spark):
    rng = np.random.default_rng(4)
    rects = [tuple(map(float, r)) for r in np.sort(rng.uniform(-0.3, 1.6, (40, 2, 2)), axis=2).reshape(40, 4)] + [(0.3, 0.3, 0.6, 0.6), (0.0, 1.2, 0.0, 1.2), (2.0, 3.0, 0.0, 1.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rects)], "src long, fl0 double, fu0 double, fl1 double, fu1 double")
    got = set(rows(covers.cover(df, 6, UNIT, ["src"])))
    cells = {r["key"]: (r["c0"], r["c1"]) for r in grid.cubes(grid.uniform(spark, 6), 6, 6, 2).collect()}
    touch = lambda a, b, c: a / 1.2 * 8 <= c + 1 + 1e-12 and b / 1.2 * 8 >= c - 1e-12
    want = {(k, key) for k, (a, b, c, d) in enumerate(rects) for key, (x, y) in cells.items() if touch(a, b, x) and touch(c, d, y)}
    assert got == want


def test_periodic_cover_wraps(spark):
    df = spark.createDataFrame([(0, 1.1, 1.3, 0.5, 0.6)], "src long, fl0 double, fu0 double, fl1 double, fu1 double")
    torus = Domain((0, 0), (1.2, 1.2), (True, False))
    keys = covers.cover(df, 6, torus, ["src"])
    cols = {r["c0"] for r in grid.cubes(keys.select(F.col("dst").alias("key")), 6, 6, 2).collect()}
    assert cols == {7, 0}
    far = df.select("src", (F.col("fl0") + 12.0).alias("fl0"), (F.col("fu0") + 12.0).alias("fu0"), "fl1", "fu1")
    assert covers.cover(far, 6, torus, ["src"], strict=True).count() == 0
    assert rows(covers.cover(far, 6, torus, ["src"], strict=False)) == rows(keys)


def test_union_intersection_and_prism(spark):
    df = spark.createDataFrame([(0, 0.1, 0.5, 0.1, 0.5)], "src long, fl0 double, fu0 double, fl1 double, fu1 double")
    a, b = covers.cover(df, 6, UNIT, ["src"]), covers.cover(df.withColumn("fl0", F.lit(0.4)), 6, UNIT, ["src"])
    assert set(rows(covers.intersection_cover([a, b]))) == set(rows(a)) & set(rows(b))
    assert set(rows(covers.union_cover([a, b]))) == set(rows(a)) | set(rows(b))
    prism = spark.createDataFrame([(0, 0.3, -0.02, 0.3, 0.02, 0.6, 0.6)], "src long, a00 double, a01 double, a10 double, a11 double, c0 double, c1 double")
    got = {r["dst"] for r in covers.prism_cover(prism, 8, UNIT, ["src"]).collect()}
    cells = {r["key"]: (r["c0"], r["c1"]) for r in grid.cubes(grid.uniform(spark, 8), 8, 8, 2).collect()}
    hit = set()
    for s, t in product(np.linspace(-1, 1, 200), repeat=2):
        x, y = 0.6 + 0.3 * s - 0.02 * t, 0.6 + 0.3 * s + 0.02 * t
        hit.add((int(x / 1.2 * 16), int(y / 1.2 * 16)))
    assert hit <= {cells[k] for k in got} and len(got) < 80


def test_prism_in_three_dimensions(spark):
    cube = Domain((0, 0, 0), (1, 1, 1))
    matrix = np.array([[0.25, 0.02, 0.0], [0.25, -0.02, 0.01], [0.25, 0.0, -0.01]])
    centre = np.array([0.5, 0.5, 0.5])
    names = [f"a{i}{j} double" for i in range(3) for j in range(3)] + [f"c{d} double" for d in range(3)]
    prism = spark.createDataFrame([(0, *matrix.ravel().tolist(), *centre.tolist())], "src long, " + ", ".join(names))
    got = {r["dst"] for r in covers.prism_cover(prism, 9, cube, ["src"]).collect()}
    cells = {(r["c0"], r["c1"], r["c2"]): r["key"] for r in grid.cubes(grid.uniform(spark, 9), 9, 9, 3).collect()}
    points = centre + np.random.default_rng(1).uniform(-1, 1, (20000, 3)) @ matrix.T
    hit = {cells[tuple(x)] for x in np.unique(np.floor(points * 8).astype(int), axis=0).tolist()}
    assert hit <= got and len(got) < 3 * len(hit) < 300


def test_published_morse_graph(spark, tmp_path):
    g = morse.morse_graph(spark, morse.Model(UNIT, PRODUCT, 6, 10, 4))
    assert g.signature() == {"sizes": [1, 1, 1, 1], "min_box": [0, 29, 58, 105], "edges": [[1, 0], [2, 0], [3, 0], [3, 1], [3, 2]], "phase_size": 124}
    assert rows(g.edges()) == [(1, 0), (2, 0), (3, 1), (3, 2)]
    assert rows(g.attractors()) == [(0,)] and rows(g.repellers()) == [(3,)]
    assert "3 -> 1;" in files.dot_text(g)
    files.save(g, str(tmp_path / "saved"))
    again = files.load(spark, str(tmp_path / "saved"), PRODUCT)
    assert again.signature() == g.signature() and again.model.domain == g.model.domain and rows(again.edges()) == rows(g.edges())
    assert rows(files.statistics(again, 2.5)) == [(124, 4, 4, 5, 2.5)]
    noted = again.annotated(spark.createDataFrame([(1, "x - 1"), (1, "0"), (1, "0"), (2, None)], "v int, note string"))
    assert '1 [label="1\\n0\\nx - 1"' in files.dot_text(noted) and '2 [label="2"' in files.dot_text(noted)


def test_charts_and_tiles_are_read(spark, tmp_path):
    xml = "<atlas><dimension>2</dimension><listcharts><chart><id>4</id><lbounds>0 1</lbounds><ubounds>2 3.5</ubounds></chart></listcharts></atlas>"
    assert files.read_charts(xml) == {4: Domain((0, 1), (2, 3.5))}
    with pytest.raises(ValueError):
        files.read_charts(xml.replace(">2</dimension>", ">3</dimension>"))
    (tmp_path / "tiles.txt").write_text("0 5\n 1   5 \n\n2 7\n")
    assert rows(files.read_tiles(spark, str(tmp_path / "tiles.txt"))) == [(0, 5), (1, 5), (2, 7)]


def test_models_are_checked():
    with pytest.raises(ValueError):
        morse.Model(UNIT, PRODUCT, 4, 6, 5)
    with pytest.raises(ValueError):
        Domain((0,), (0,))
    with pytest.raises(ValueError):
        maps.ExpressionMap(lambda x: x, "edges")


def brute_recurrence(edges):
    keys = sorted({x for e in edges for x in e})
    at = {k: i for i, k in enumerate(keys)}
    reach = np.zeros((len(keys), len(keys)), bool)
    for a, b in edges:
        reach[at[a], at[b]] = True
    for k in range(len(keys)):
        reach |= np.outer(reach[:, k], reach[k])
    comp = {k: min(keys[j] for j in range(len(keys)) if reach[i, j] and reach[j, i]) for i, k in enumerate(keys) if reach[i, i]}
    pairs = {(comp[a], comp[b]) for a in comp for b in comp if reach[at[a], at[b]]}
    return {(c, k) for k, c in comp.items()}, pairs


@pytest.mark.parametrize("way", ["one part", "many parts", "groups", "groups of few edges", "groups of few components"])
def test_recurrence(spark, way):
    rng = np.random.default_rng(9)
    graphs = {n: {tuple(map(int, e)) for e in rng.integers(0, 14, (16, 2))} for n in range(3)} | {9: {(1, 2), (2, 3)}}
    graphs[4] = {(k, k) for k in range(0, 9, 2)} | {(k, k + 1) for k in range(8)} | {(8, 20), (20, 21), (21, 20), (21, 8)}
    df = spark.createDataFrame([(n, a, b) for n, es in graphs.items() for a, b in es], "node long, src long, dst long")
    bounds = {"groups": (), "groups of few edges": (14,), "groups of few components": (graph.GROUP_EDGES, 1)}
    parts = {"one part": 10**6, "many parts": 40}
    members, reach = graph.recurrence(df, parts[way]) if way in parts else graph.recurrence_of_many(df, *bounds[way])
    got, pairs = rows(members.select("node", "comp", "key")), rows(reach.select("node", "comp", "other"))
    for n, es in graphs.items():
        want, wanted = brute_recurrence(es)
        assert {r[1:] for r in got if r[0] == n} == want
        assert {r[1:] for r in pairs if r[0] == n} == wanted
    assert len(pairs) == len(set(pairs)) and len(got) == len(set(got))


def test_recurrence_of_a_larger_digraph_in_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_WORDS", 1)
    rng = np.random.default_rng(21)
    edges = {(k, k) for k in range(0, 300, 2)} | {(k, int(k + rng.integers(1, 6))) for k in range(400) for _ in range(2)} | {(300 + k, 300 + (k + 1) % 40) for k in range(40)}
    edges |= {(500 + k, 501 + k) for k in range(30)} | {(1 << 40, 7), (399, 1 << 41)}
    members, reach = graph.recurrence(spark.createDataFrame([(5, a, b) for a, b in edges], "node long, src long, dst long"), 120)
    want, wanted = brute_recurrence(edges)
    assert len({c for c, _ in want}) > 128  # three words, a block each
    assert {r[1:] for r in rows(members.select("node", "comp", "key"))} == want
    got = rows(reach.select("comp", "other"))
    assert set(got) == wanted and len(got) == len(wanted)


def test_sizes_of_cuts_don_t_multiply(spark):
    import time

    from dynspark.plans.cutting import cut

    df = cut(spark.range(20).selectExpr("id AS a", "id + 1 AS b"))
    for _ in range(60):
        began = time.time()
        df = cut(df.join(df.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("a", "b").distinct())
        assert time.time() - began < 20
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size).bit_length() < 40 and df.count() == 20


def test_recurrence_of_a_cycle_and_a_way(spark):
    edges = spark.range(20).selectExpr("0L AS node", "id AS src", "CASE WHEN id = 13 THEN 0 ELSE id + 1 END AS dst").union(spark.createDataFrame([(0, 5, 14), (0, 20, 20)], "node long, src long, dst long"))
    members, reach = graph.recurrence(edges, 12)
    assert rows(members.groupBy("comp").count()) == [(0, 14), (20, 1)]
    assert rows(reach.select("comp", "other")) == [(0, 0), (0, 20), (20, 20)]


@pytest.mark.parametrize("name", ["q07_cover_uniform", "q09_subgrid_edges"])
def test_no_filter_on_ranges_reaches_the_scan(spark, name):
    from conftest import SMALL

    from dynspark.plans.queries import QUERIES

    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :]
    assert "sequence" in plan and "sequence" not in below and "Filter" not in below


def test_reduction_of_an_order(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 2)], "u long, v long")
    assert rows(graph.transitive_reduction(edges)) == [(0, 1), (1, 2)]


def test_join_and_subset_of_mixed_grids(spark):
    a = grid.uniform(spark, 2).filter("key < 3").select(F.lit(2).alias("depth"), "key")
    b = grid.uniform(spark, 4).filter("key < 2").select(F.lit(4).alias("depth"), "key")
    joined = grid.join_grids(a, b, a)
    assert rows(joined) == [(2, 1), (2, 2), (4, 0), (4, 1)]
    assert rows(grid.join_grids(joined, joined)) == rows(joined)
    assert rows(grid.subset(joined, a.filter("key = 0"))) == [(4, 0), (4, 1)]
    ranks = {(r["depth"], r["key"]): r["ge"] for r in grid.ranked(joined).collect()}
    assert ranks == {(4, 0): 0, (4, 1): 1, (2, 1): 2, (2, 2): 3}


def mixed(rng, n, deepest=7):
    return {(int(d), int(rng.integers(0, 1 << d))) for d in rng.integers(1, deepest + 1, n)}


@pytest.mark.parametrize("seed", range(3))
def test_sweeps_of_mixed_grids(spark, seed):
    rng = np.random.default_rng(seed)
    boxes, other = mixed(rng, 40), mixed(rng, 12)
    below = lambda a, b: b[0] >= a[0] and b[1] >> (b[0] - a[0]) == a[1]
    frame = lambda x: spark.createDataFrame(sorted(x) + sorted(x)[:3], "depth int, key long").repartition(3)
    leaves = sorted((b for b in boxes if not any(below(b, o) for o in boxes if o != b)), key=lambda b: b[1] << (62 - b[0]))
    assert rows(grid.join_grids(frame(boxes))) == sorted(leaves)
    assert rows(grid.joined_and_ranked(frame(boxes)).select("depth", "key", "ge")) == sorted((*b, k) for k, b in enumerate(leaves))
    got = grid.subset(spark.createDataFrame([(*b, "x") for b in sorted(boxes)], "depth int, key long, more string"), frame(other))
    assert got.columns == ["depth", "key", "more"]
    assert rows(got.select("depth", "key")) == sorted(b for b in boxes if any(below(o, b) or below(b, o) for o in other))
    assert grid.subset(frame(boxes), frame(other).limit(0)).count() == 0 and grid.join_grids(frame(boxes).limit(0)).count() == 0


@pytest.mark.parametrize("periodic", [(), (True, False)])
def test_cover_of_a_mixed_grid(spark, periodic):
    rng = np.random.default_rng(8)
    leaves = grid.join_grids(spark.createDataFrame(sorted(mixed(rng, 60, 8)), "depth int, key long"))
    domain = Domain((0.0, 0.0), (1.2, 1.2), periodic)
    low = rng.uniform(-0.3, 1.3, (50, 2))
    high = low + rng.uniform(0, 0.7, (50, 2))
    images = spark.createDataFrame([(k, *map(float, (a[0], b[0], a[1], b[1]))) for k, (a, b) in enumerate(zip(low, high, strict=True))], "src long, fl0 double, fu0 double, fl1 double, fu1 double")
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())
    got = rows(covers.cover_mixed(images, leaves, depths, domain, ["src"]).select("src", "depth", "dst"))
    want = []
    for d in depths:
        want += rows(covers.cover(images, d, domain, ["src"]).join(leaves.filter(F.col("depth") == d).select(F.col("key").alias("dst")), "dst").select("src", F.lit(d), "dst"))
    assert got == sorted(want) and len(got) > 50


def test_sampled_map_against_a_scan(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1.2, (1500, 2))
    samples = spark.createDataFrame([(*map(float, p), float(p[0] * 2), float(p[1] - 1)) for p in x], "x0 double, x1 double, y0 double, y1 double")
    boxes = with_rects(grid.uniform(spark, 10), 10, UNIT)
    for options in ({"empty": "outside"}, {"empty": "outside", "padding": True}, {"empty": "interp"}, {"empty": "outside", "domain_padding": True}):
        got = maps.DataMap(samples, UNIT, **options).image(boxes, 2).collect()
        assert len(got) == 1024
        for r in got[::37]:
            lo, hi = np.array([r["l0"], r["l1"]]), np.array([r["u0"], r["u1"]])
            width = hi - lo
            pick = lambda a, b: ((x >= a) & (x <= b)).all(1)
            inside = pick(lo, hi)
            if options.get("domain_padding") and inside.any():
                inside = pick(lo - width, hi + width)
            a, b = lo, hi
            while options["empty"] == "interp" and not inside.any():
                a, b = (a + b) / 2 - (b - a), (a + b) / 2 + (b - a)
                inside = pick(a, b)
            if inside.any():
                y = np.stack([x[inside, 0] * 2, x[inside, 1] - 1], 1)
                pad = width if options.get("padding") else 0
                want = [*(y.min(0) - pad), *(y.max(0) + pad)]
            else:
                pad = width if options.get("padding") else np.zeros(2)
                want = [2.2, 2.2, 3.2, 3.2]
                if options.get("padding"):
                    continue
            assert np.allclose([r["fl0"], r["fl1"], r["fu0"], r["fu1"]], want)
    with pytest.raises(ValueError):
        maps.DataMap(samples.limit(5), UNIT, empty="terminate").image(boxes, 2)


def test_bins_of_few_rectangles_do_not_go_through_the_driver(spark):
    """A table of few rectangles looks small, but each may have thousands of bins."""
    samples = spark.range(3000).select((F.rand(1) * 1.2).alias("x0"), (F.rand(2) * 1.2).alias("x1")).withColumns({"y0": F.col("x0"), "y1": F.col("x1")})
    found = maps.DataMap(samples, UNIT).hulls(with_rects(grid.uniform(spark, 4), 4, UNIT).withColumnRenamed("key", "row"), 2)
    assert found.count() == 16
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_a_grid_need_no_samples(spark):
    """Bins along the border whose samples are all inside or all outside answer from the pyramid; the largest bins come from a middle level."""
    samples = spark.range(6000).select((F.rand(1) * 1.2).alias("x0"), (F.rand(2) * 1.2).alias("x1")).withColumns({"y0": F.col("x0") * 2, "y1": F.col("x1")})
    samples = spark.createDataFrame([*map(tuple, samples.collect()), (None, 0.1, 9.0, 9.0)], "x0 double, x1 double, y0 double, y1 double")
    table, boxes = maps.DataMap(samples, UNIT), with_rects(grid.uniform(spark, 4), 4, UNIT).withColumnRenamed("key", "row")
    assert table.halvings > maps.LOWEST
    binned, pyramid, ends = table.tables()
    assert pyramid.groupBy("level").agg(F.sum("points").alias("n")).select("n").distinct().collect() == [(6000,)]
    table._tables = binned.withColumn("x0", F.raise_error(F.lit("samples are read")).cast("double")), pyramid, ends
    got = {r["row"]: tuple(r)[1:] for r in table.hulls(boxes, 2).collect()}
    points = np.array([tuple(r) for r in samples.collect() if r["x0"] is not None])
    for r in boxes.collect():
        own = points[(points[:, 0] >= r["l0"]) & (points[:, 0] <= r["u0"]) & (points[:, 1] >= r["l1"]) & (points[:, 1] <= r["u1"])]
        assert got[r["row"]] == (own[:, 2].min(), own[:, 2].max(), own[:, 3].min(), own[:, 3].max(), len(own))


def test_a_rectangle_over_all_samples_costs_one_row(spark):
    rng = np.random.default_rng(4)
    samples = spark.createDataFrame([tuple(map(float, p)) for p in rng.uniform(0.1, 1.1, (3000, 4))], "x0 double, x1 double, y0 double, y1 double")
    table = maps.DataMap(samples, UNIT)
    rects = spark.createDataFrame([(0, 0.0, 1.2, 0.0, 1.2), (1, 0.0, 1.2, 0.3, 0.9), (2, 0.35, 0.8, 0.2, 0.7), (3, 0.5, 0.5, 0.1, 1.1), (4, 2.0, 3.0, 0.0, 1.0)], "row long, l0 double, u0 double, l1 double, u1 double")
    assert table.halvings == 4
    asked, bins = [], table._bins
    table._bins = lambda *a: asked.append(bins(*a)) or asked[-1]
    got = {r["row"]: tuple(r)[1:] for r in table.hulls(rects, 2).collect()}
    whole, border = ({r["row"]: r["count"] for r in df.groupBy("row").count().collect()} for df in asked)
    assert whole[0] == 1 and 0 not in border and whole[1] + border[1] < 16 * 16 / 3 and 4 not in got
    rows_ = np.array([tuple(r) for r in samples.collect()])
    for r in rects.collect():
        own = rows_[(rows_[:, 0] >= r["l0"]) & (rows_[:, 0] <= r["u0"]) & (rows_[:, 1] >= r["l1"]) & (rows_[:, 1] <= r["u1"])]
        if len(own):
            assert got[r["row"]] == (own[:, 2].min(), own[:, 2].max(), own[:, 3].min(), own[:, 3].max(), len(own))


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_doublings_against_a_loop(spark, dim):
    rng = np.random.default_rng(dim)
    x = np.r_[rng.uniform(0.9, 1.0, (300, dim)), rng.uniform(-0.3, 1.5, (4, dim)) if dim == 2 else rng.uniform(0, 0.05, (40, dim))]
    samples = spark.createDataFrame([tuple(map(float, np.r_[p, p * 2])) for p in x], ", ".join(f"{n}{d} double" for n in "xy" for d in range(dim)))
    domain = Domain((0.0,) * dim, (1.2,) * dim)
    low = rng.uniform(0, 1.1, (60, dim))
    high = low + rng.uniform(0.001, 0.08, (60, dim)) * rng.choice([0.05, 1.0], (60, dim))
    rects = spark.createDataFrame([tuple(map(float, np.stack([a, b], 1).reshape(-1))) for a, b in zip(low, high, strict=True)], ", ".join(f"{e}{d} double" for d in range(dim) for e in "lu"))
    for r in maps.DataMap(samples, domain).image(rects, dim).collect():
        a, b = np.array([r[f"l{d}"] for d in range(dim)]), np.array([r[f"u{d}"] for d in range(dim)])
        while not (inside := ((x >= a) & (x <= b)).all(1)).any():
            a, b = (a + b) / 2 - (b - a), (a + b) / 2 + (b - a)
        assert [(r[f"fl{d}"], r[f"fu{d}"]) for d in range(dim)] == [((x[inside, d] * 2).min(), (x[inside, d] * 2).max()) for d in range(dim)]


def test_doublings_of_flat_and_lost_rectangles(spark):
    samples = spark.createDataFrame([(0.5, 0.25, 1.0, 2.0)], "x0 double, x1 double, y0 double, y1 double")
    flat = spark.createDataFrame([(0.5, 0.5, 0.0, 0.01)], "l0 double, u0 double, l1 double, u1 double")
    assert tuple(maps.DataMap(samples, UNIT).image(flat, 2).first())[4:] == (1.0, 1.0, 2.0, 2.0)
    with pytest.raises(Exception, match="too far"):
        maps.DataMap(samples, UNIT).image(flat.withColumns({"l0": F.lit(0.4), "u0": F.lit(0.4)}), 2).collect()


def test_tabulated_map(spark):
    f = lambda x: [c * (1.2 - c) for c in x]
    boxes = with_rects(grid.uniform(spark, 6), 6, UNIT)
    names = ["key", "fl0", "fu0", "fl1", "fu1"]
    direct = maps.ExpressionMap(f).image(boxes, 2).select(names)
    table = maps.LatticeMap(spark, f, UNIT, 8)
    assert np.allclose(rows(table.image(boxes, 2).select(names)), rows(direct), atol=1e-12)
    with pytest.raises(Exception, match="isn't on the lattice"):
        table.image(with_rects(grid.uniform(spark, 12), 12, UNIT), 2).collect()
    with pytest.raises(ValueError):
        maps.LatticeMap(spark, f, UNIT, 40, most_nodes=1000)


def test_python_maps_agree_with_expressions_and_are_checked(spark):
    boxes = with_rects(grid.uniform(spark, 6), 6, UNIT)
    names = ["key", "fl0", "fu0", "fl1", "fu1"]
    want = rows(PRODUCT.image(boxes, 2).select(names))
    assert rows(maps.point_batch(lambda x: x / (2 - x)).image(boxes, 2).select(names)) == want
    assert rows(maps.scalar_map(lambda r: [v / (2 - v) for v in r]).image(boxes, 2).select(names)) == want
    for bad in (lambda r: r[:, :1], lambda r: r.tolist()):
        with pytest.raises(Exception, match="batch map"):
            maps.BatchMap(bad).image(boxes, 2).collect()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-6, 6), st.floats(0, 7), st.floats(-3, 3), st.floats(0, 3)), min_size=3, max_size=12))
def test_intervals_hold_their_values(spark, ends):
    df = spark.createDataFrame([(a, a + w, c, c + v) for a, w, c, v in ends], "a double, b double, c double, d double")
    x, y = iv.Interval(F.col("a"), F.col("b")), iv.Interval(F.col("c"), F.col("d"))
    made = {"add": (x + y, np.add), "sub": (x - y, np.subtract), "mul": (x * y, np.multiply), "cos": (iv.cos(x), lambda p, q: np.cos(p)), "sin": (iv.sin(x), lambda p, q: np.sin(p)), "square": (iv.square(x), lambda p, q: p * p), "tanh": (iv.tanh(x), lambda p, q: np.tanh(p)), "tan": (iv.tan(x), lambda p, q: np.tan(p))}
    for r in df.select("*", *[c.alias(f"{n}_{e}") for n, (i, _) in made.items() for e, c in (("lo", i.lo), ("hi", i.hi))]).collect():
        p, q = (m.ravel() for m in np.meshgrid(np.linspace(r["a"], r["b"], 25), np.linspace(r["c"], r["d"], 9)))
        for name, (_, f) in made.items():
            value = f(p, q)
            if name == "tan":
                value = value[np.abs(value) < 1e6]
            assert (value >= r[f"{name}_lo"] - 1e-9).all() and (value <= r[f"{name}_hi"] + 1e-9).all(), name


def test_boundary_of_a_boundary_vanishes(spark):
    cubes = spark.createDataFrame([(x, y, z) for x in range(3) for y in range(2) for z in range(2)], "c0 long, c1 long, c2 long")
    chain = cubes.select(*[(F.col(f"c{d}") * 2 + 1).alias(f"e{d}") for d in range(3)], (F.col("c0") + 1).cast("int").alias("coef"))
    once = cubical.boundary(chain, 3)
    assert once.count() > 0 and cubical.boundary(once, 3).count() == 0
    assert rows(cubical.euler_characteristic(cubical.cells(cubes, 3))) == [(1,)]


def test_files_round_trip(spark, tmp_path):
    boxes = with_rects(grid.uniform(spark, 4), 4, UNIT).withColumn("v", F.lit(2).cast("long"))
    files.write_sets(boxes, str(tmp_path / "sets"), 2)
    assert rows(files.read_sets(spark, str(tmp_path / "sets"), 2)) == rows(boxes.select("l0", "l1", "u0", "u1", "v"))
    (tmp_path / "data.txt").write_text("  1.5   2 3\t4\n\n# no\n5 6 7 8e-1\n")
    assert rows(files.read_samples(spark, str(tmp_path / "data.txt"), 2)) == [(1.5, 2.0, 3.0, 4.0), (5.0, 6.0, 7.0, 0.8)]
    (tmp_path / "cubes.txt").write_text("(3,-1)\n(4, 0)\n")
    assert rows(files.cubes_from_text(spark, str(tmp_path / "cubes.txt"), 2)) == [(0, 0), (1, 1)]
    text = "<config><model><name>m</name></model><phase><subdiv><min>4</min><max>6</max></subdiv><bounds><lower>0 0</lower><upper>1 2</upper></bounds><periodic>0 1</periodic></phase></config>"
    found = files.read_settings(text)
    assert found.depths == (4, 6, 0, 10000) and found.phase == Domain((0, 0), (1, 2), (False, True))


def test_lattices(spark):
    near = grid.adjacent(spark, [3, 3])
    assert near.filter("src = 4").count() == 9 and near.filter("src = 0").count() == 4
    assert grid.adjacent(spark, [4, 4], (True, True)).filter("src = 0").count() == 9
    assert grid.lattice_edges(spark, [2, 3]).count() == 2 * 4 + 3 * 3
    within = grid.patches(spark, [9, 9]).alias("a").join(grid.patches(spark, [9, 9]).alias("b"), "patch").select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()
    assert grid.adjacent(spark, [9, 9]).join(within, ["src", "dst"], "left_anti").count() == 0


def test_no_cartesian_product_in_a_cover(spark):
    boxes = grid.uniform(spark, 8).withColumn("node", F.lit(0).cast("long"))
    from dynspark.functions.boxes import with_cells

    plan = morse.transitions(morse.uniform_model(UNIT, PRODUCT, 8), with_cells(boxes, 8, 2), 8)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


# --- complexes and edge grids -----------------------------------------------------------------------------------------


def chain(spark, terms):
    return spark.createDataFrame(terms, "e0 long, e1 long, coef long")


def test_boundaries_on_a_torus_vanish_twice(spark):
    rng = np.random.default_rng(6)
    squares = chain(spark, [(2 * a + 1, 2 * b + 1, int(rng.integers(1, 5))) for a in range(3) for b in range(4)])
    once = cubical.boundary(squares, 2, sizes=[3, 4])
    assert once.count() and cubical.boundary(once, 2, sizes=[3, 4]).count() == 0
    assert all(0 <= r["e0"] < 6 and 0 <= r["e1"] < 8 for r in once.collect())
    whole = chain(spark, [(2 * a + 1, 2 * b + 1, 1) for a in range(3) for b in range(4)])
    assert cubical.boundary(whole, 2, sizes=[3, 4]).count() == 0  # a torus has no boundary
    assert cubical.boundary(whole, 2, sizes=[0, 4]).filter("e0 not in (0, 6)").count() == 0  # a cylinder has two circles
    every = cubical.cells(spark.createDataFrame([(a, b) for a in range(3) for b in range(4)], "c0 long, c1 long"), 2, [3, 4])
    points = chain(spark, [(0, 0, 1), (2, 4, 3)])
    up = cubical.coboundary(points, every, 2, sizes=[3, 4])
    assert up.count() == 8 and cubical.coboundary(up, every, 2, sizes=[3, 4]).count() == 0


def test_relative_cells_wrap_where_the_set_spans_a_circle(spark):
    torus = Domain((0.0, 0.0), (1.0, 1.0), (True, False))
    box = lambda d, c0, c1: spark.range(1).select(key_of([F.lit(c0), F.lit(c1)], d).alias("k")).first()["k"]
    ring = [("ring", 4, box(4, a, 1)) for a in range(4)]
    arc = [("arc", 4, box(4, a, 2)) for a in (1, 2)] + [("arc", 2, box(2, 1, 0))]
    x = spark.createDataFrame(ring + arc, "g string, depth int, key long")
    none = x.limit(0)
    counts = lambda df: {(r["g"], r["dim"]): r["count"] for r in df.groupBy("g", "dim").count().collect()}
    got = cubical.relative_complex(x, none, 4, torus, ["g"])
    assert {k: n for k, n in counts(got).items() if k[0] == "ring"} == {("ring", 0): 8, ("ring", 1): 12, ("ring", 2): 4}
    assert sum((-1) ** k[1] * n for k, n in counts(got).items() if k[0] == "arc") == 1 and counts(got)["arc", 2] == 6
    assert got.filter("g = 'arc'").agg(F.min("e0"), F.min("e1")).first() == (0, 0)
    less = cubical.relative_complex(x, spark.createDataFrame([("ring", 6, box(6, 0, 2))], "g string, depth int, key long"), 4, torus, ["g"])
    assert {k: n for k, n in counts(less).items() if k[0] == "ring"} == {("ring", 0): 4, ("ring", 1): 8, ("ring", 2): 3}


def test_edge_numbers_and_places(spark):
    sizes = [3, 2, 4]
    every = grid.lattice_edges(spark, sizes).withColumn("id", grid.edge_id(sizes))
    ids = sorted(r["id"] for r in every.collect())
    assert ids == list(range(len(ids))) and len(ids) == 3 * 3 * 5 + 4 * 2 * 5 + 4 * 3 * 4
    back = every.select("id", "axis", *[F.col(f"c{d}").alias(f"k{d}") for d in range(3)]).withColumns({f"p_{n}": c for n, c in grid.edge_place(sizes).items()})
    assert back.filter("p_axis != axis or p_c0 != k0 or p_c1 != k1 or p_c2 != k2").count() == 0
    assert spark.createDataFrame([(0, 3, 0, 0), (1, 3, 2, 0), (2, -1, 0, 0)], "axis int, c0 long, c1 long, c2 long").filter(grid.edge_id(sizes).isNotNull()).count() == 0


def test_lattice_neighbours_and_cells(spark):
    given = spark.createDataFrame([(0, 0), (1, 0), (4, 3), (3, 3)], "c0 long, c1 long")
    for periodic in ((), (True, True)):
        whole = rows(grid.adjacent(spark, [5, 4], periodic))
        ids = {0, 1, 19, 18}
        assert rows(grid.adjacent_cells(given, [5, 4], periodic)) == sorted(p for p in whole if p[0] in ids and p[1] in ids)
    assert rows(grid.patches_of(given, [5, 4], 2).select("patch", "id")) == sorted(p for p in rows(grid.patches(spark, [5, 4], 2).select("patch", "id")) if p[1] in ids)
    assert grid.adjacent(spark, [2, 2], (True, True)).count() == 16


def test_rectangles_are_compared_in_single_precision(spark):
    from dynspark.functions import boxes

    df = spark.createDataFrame([(0.1, 0.2, 0.1 + 1e-12, 0.2), (0.1, 0.2, 0.1 + 1e-6, 0.2)], "l0 double, u0 double, ol0 double, ou0 double")
    assert [r[0] for r in df.select(boxes.same_rect(1)).collect()] == [True, False]
    assert df.select(boxes.rect_hash(1)).distinct().count() == 1
    assert tuple(df.limit(1).withColumns(boxes.added(1)).withColumns(boxes.scaled(-2.0, 1)).withColumns(boxes.centroid(1)).select("l0", "u0").first()) == pytest.approx((-0.6, -0.6))


def test_morse_graph_of_a_map_that_leaves(spark):
    g = morse.morse_graph(spark, morse.Model(UNIT, maps.ExpressionMap(lambda x: [c + 5.0 for c in x]), 4, 6, 2))
    assert g.signature() == {"sizes": [], "min_box": [], "edges": [], "phase_size": 4}
    assert g.num_vertices() == g.edges().count() == g.map_graph().count() == g.boxes().count() == 0


def test_closures_and_stars(spark):
    """Against sets of faces made by hand, on a lattice of 3 x 4 squares, the first axis a circle."""
    every = cubical.cells(grid.lattice(spark, [3, 4]), 2, [3, 0])
    some = spark.createDataFrame([(5, 1), (5, 1), (0, 4), (1, 2)], "e0 long, e1 long")
    beside = lambda e, n, odd: [(e + k) % n if n else e + k for k in ((-1, 0, 1) if e % 2 == odd else (0,))]
    plain = lambda df: sorted((r["e0"], r["e1"], r["dim"]) for r in df.collect())
    there = {(r["e0"], r["e1"]) for r in every.collect()}
    for odd, got in ((1, cubical.closure(some, 2, [3, 0])), (0, cubical.star(some, every, 2, [3, 0]))):
        want = {(a, b) for x, y in [(5, 1), (0, 4), (1, 2)] for a in beside(x, 6, odd) for b in beside(y, 0, odd)} & there
        assert plain(got) == sorted((a, b, a % 2 + b % 2) for a, b in want)
    assert cubical.closure(some.limit(0), 2).count() == cubical.star(some.limit(0), every, 2).count() == 0


@pytest.mark.parametrize("circles", [(), (True, True, False)])
def test_boundary_matrices_multiply_to_zero(spark, circles):
    sizes = [3, 2, 2]
    every = cubical.cells(grid.lattice(spark, sizes), 3, [n if circles and circles[d] else 0 for d, n in enumerate(sizes)])
    counts = {r["dim"]: r["n"] for r in cubical.face_counts(every).collect()}
    found = {}
    for r in cubical.boundary_matrix(every, sizes, circles).collect():
        found.setdefault(r["dim"], np.zeros((counts[r["dim"] - 1], counts[r["dim"]]), int))[r["row"], r["column"]] = r["value"]
    assert sorted(found) == [1, 2, 3] and all(m.any() for m in found.values())
    assert not (found[1] @ found[2] % 5).any() and not (found[2] @ found[3] % 5).any()
    numbers = cubical.numbered(every, sizes)
    back = numbers.withColumns({f"b{x[1:]}": c for x, c in cubical.cell_at(sizes).items()})
    assert back.filter("e0 != b0 or e1 != b1 or e2 != b2").count() == 0 and numbers.select("address").distinct().count() == sum(counts.values())
    with pytest.raises(ValueError):
        cubical.address([1 << 30, 1 << 30])


def test_boundaries_in_a_subcomplex(spark):
    """Without one of its ends the boundary of an edge is the other end."""
    chain = spark.createDataFrame([(1, 0, 2)], "e0 long, e1 long, coef int")
    some = spark.createDataFrame([(2, 0), (1, 0)], "e0 long, e1 long")
    assert [tuple(r) for r in cubical.projected(cubical.boundary(chain, 2), some, 2).collect()] == [(2, 0, 2)]


@pytest.mark.parametrize("p", [2, 5, 101, 2147483647])
def test_arithmetic_modulo_a_prime(spark, p):
    numbers = [0, 1, -1, 2, p - 1, p, p + 1, -3 * p - 2, 123456789012, None]
    rows = spark.createDataFrame([(x, y) for x in numbers for y in numbers], "x long, y long")
    x, y = F.col("x"), F.col("y")
    for r in rows.select("x", "y", fields.plus(x, y, p).alias("plus"), fields.minus(x, y, p).alias("minus"), fields.times(x, y, p).alias("times"), fields.over(x, y, p).alias("over"), fields.balanced(x, p).alias("b")).collect():
        if r["x"] is None or r["y"] is None:
            assert r["plus"] is r["minus"] is r["times"] is r["over"] is None and (r["x"] is not None or r["b"] is None)
            continue
        assert (r["plus"], r["minus"], r["times"]) == ((r["x"] + r["y"]) % p, (r["x"] - r["y"]) % p, r["x"] * r["y"] % p)
        assert r["over"] == (r["x"] * pow(r["y"], -1, p) % p if r["y"] % p else None)
        assert (r["b"] - r["x"]) % p == 0 and -p < 2 * r["b"] <= p


def test_edges_are_added_and_taken_away(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 1, 2), (0, 2, 2), (1, 1, 2)], "node long, src long, dst long")
    back, loops = edges.select("node", F.col("dst").alias("src"), F.col("src").alias("dst")), edges.filter("src = dst")
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    assert pairs(graph.edited(edges)) == [(0, 1, 2), (0, 2, 2), (1, 1, 2)]
    assert pairs(graph.edited(edges, None, loops)) == [(0, 1, 2), (1, 1, 2)]
    assert pairs(graph.edited(edges, back.filter("node = 0"), loops)) == [(0, 1, 2), (0, 2, 1), (0, 2, 2), (1, 1, 2)]
    assert pairs(graph.components(graph.edited(edges, back.filter("src != dst"), loops)).select("node", "comp", "key")) == [(0, 1, 1), (0, 1, 2), (1, 1, 1), (1, 1, 2)]


def test_patches_of_pairs(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (3, 3), (0, 3)], "c0 long, c1 long")
    assert sorted(map(tuple, grid.pair_patches(cells, [4, 4]).collect()), key=str) == [(0, 5), (12, None), (15, None)]
    assert sorted(map(tuple, grid.pair_patches(cells, [4, 4], (True, True)).collect())) == [(0, 5), (0, 12), (0, 15), (12, 15)]
