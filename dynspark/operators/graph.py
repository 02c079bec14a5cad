"""Recurrence of digraphs held as edges (node, src, dst): many graphs at once, one for each node.

A graph of at most GROUP_EDGES edges is a task's own, and thousands of them run side by side. A larger one is trimmed (a
vertex without edges in or out is in no cycle), then its vertices get colours, which go both ways over parts of the edges that
are ranges of keys, so that near boxes share a part; what isn't settled shrinks every turn, and from GROUP_EDGES on a task ends it.
Reachability among components goes backwards over the condensed graph as bits, 64 components to a word and a row for each vertex and word that
isn't zero. Lineage is cut every round; a hub is rows like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.plans.cutting import cut

#: Edges of a part, and of a graph that a task takes by itself, at most about (measured: a million take 134 MB and 4.5 s in Python);
#: components of such a graph at most, above which what they reach is found from the condensed graph.
GROUP_EDGES, GROUP_COMPONENTS = 1_000_000, 2000
#: Trimming goes on while a round takes away at least this share of the edges.
TRIM_SHARE, TRIM_ROUNDS = 0.1, 4
#: Words of 64 components that a task of reachability holds of each vertex.
BLOCK_WORDS = 64


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, int]:
    """The component of each vertex 0 .. n - 1, numbered so that edges lead to equal or lower numbers (one depth-first walk)."""
    order = np.argsort(src, kind="stable")
    to = dst[order].tolist()
    begin = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, comp = [-1] * n, [0] * n, [-1] * n
    at = begin[:-1].copy()
    clock = done = 0
    held: list[int] = []
    for start in range(n):
        if index[start] >= 0:
            continue
        path = [start]
        index[start] = low[start] = clock
        clock += 1
        held.append(start)
        while path:
            v = path[-1]
            if at[v] < begin[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    held.append(w)
                    path.append(w)
                elif comp[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
            else:
                path.pop()
                if path and low[v] < low[path[-1]]:
                    low[path[-1]] = low[v]
                if low[v] == index[v]:
                    while True:
                        w = held.pop()
                        comp[w] = done
                        if w == v:
                            break
                    done += 1
    return np.array(comp, np.int64), done


def _one(key: tuple, t: pa.Table, most: int) -> pa.Table:
    """Recurrent components of one graph and what they reach. kind 0: node, comp, key; kind 1: node, comp, reached comp; kind 2: node has
    more than most components, and what they reach is left to joins."""
    s, d = t.column("src").to_numpy(), t.column("dst").to_numpy()
    keys, flat = np.unique(np.concatenate([s, d]), return_inverse=True)
    src, dst = flat[: len(s)], flat[len(s) :]
    comp, n = strong_components(len(keys), src, dst)
    size = np.bincount(comp, minlength=n)
    recurrent = size > 1
    recurrent[comp[src[src == dst]]] = True
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, comp, keys)
    member = recurrent[comp]
    named = np.flatnonzero(recurrent)
    a = b = np.zeros(0, np.int64)
    if few := len(named) <= most:
        between = np.unique(np.stack([comp[src], comp[dst]], 1), axis=0)
        between = between[between[:, 0] != between[:, 1]]
        bit = {c: 1 << k for k, c in enumerate(named.tolist())}
        reach = [bit.get(c, 0) for c in range(n)]
        for x, y in between[np.argsort(between[:, 0], kind="stable")].tolist():  # lower numbers are complete
            reach[x] |= reach[y]
        wide = -(-len(named) // 8)
        seen = [np.flatnonzero(np.unpackbits(np.frombuffer(reach[c].to_bytes(wide, "little"), np.uint8), bitorder="little")) for c in named.tolist()]
        a, b = np.repeat(named, [len(x) for x in seen]), named[np.concatenate(seen)] if seen else named
    rows, more = int(member.sum()), 0 if few else 1
    none = np.zeros(more, np.int64)
    return pa.table({
        "kind": pa.array(np.repeat([0, 1, 2], [rows, len(a), more]).astype(np.int32)),
        "node": pa.array([key[0].as_py()] * (rows + len(a) + more), pa.int64()),
        "comp": pa.array(np.r_[least[comp[member]], least[a], none].astype(np.int64)),
        "other": pa.array(np.r_[keys[member], least[b], none].astype(np.int64)),
    })


def _priorities(keys: np.ndarray, turn: int) -> np.ndarray:
    """A number for each key, all different (each step is a bijection), in another order each turn."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _colored(t: pa.Table, turn: int) -> pa.Table:
    """A part of the edges, perhaps with colours of their ends (as, bs, ad, bd). node, key, above, below: the highest colours that reach
    a vertex and that it reaches, as far as these edges lead."""
    node, src, dst = (t.column(c).to_numpy() for c in ("node", "src", "dst"))
    ends = np.stack([np.r_[node, node], np.r_[src, dst]], 1)
    vertices, flat = np.unique(ends, axis=0, return_inverse=True)
    flat = flat.reshape(-1)
    s, d = flat[: len(src)], flat[len(src) :]
    if "as" in t.column_names:
        above, below = (np.full(len(vertices), np.iinfo(np.int64).min) for _ in range(2))
        for at, x, y in ((s, "as", "bs"), (d, "ad", "bd")):
            above[at], below[at] = t.column(x).to_numpy(), t.column(y).to_numpy()
    else:
        above = _priorities(vertices[:, 1], turn)
        below = above.copy()
    for color, into, out in ((above, d, s), (below, s, d)):
        order = np.argsort(into, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(into[order]) != 0])
        to, of = into[order][starts], out[order]
        while True:
            best = np.maximum.reduceat(color[of], starts)
            if not (best > color[to]).any():
                break
            color[to] = np.maximum(color[to], best)
    return pa.table({"node": vertices[:, 0], "key": vertices[:, 1], "above": above, "below": below})


def _in_parts(edges: DataFrame, parts: int) -> DataFrame:
    """edges (node, src, dst) with part, a range of keys of about as many edges as the others; a hub may lie in several."""
    names = ["node", "src", "dst"]
    if parts == 1:
        return cut(edges.select(*names, F.lit(0).alias("part")))
    return cut(edges.select(*names).repartitionByRange(parts, *names).withColumn("part", F.spark_partition_id()))


def _colors(rest: DataFrame, parts: int, turn: int) -> DataFrame:
    """rest: node, src, dst, part. node, key, above, below at which nothing changes any more."""
    kind = "node long, key long, above long, below long"
    color = rest.groupBy("part").applyInArrow(lambda t: _colored(t, turn), kind)
    total = None
    while parts > 1:
        color = cut(color.groupBy("node", "key").agg(F.max("above").alias("above"), F.max("below").alias("below")))
        now = color.agg(F.sum(F.xxhash64("above", "below", "node", "key").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
        end = lambda name: color.select("node", F.col("key").alias(name), F.col("above").alias(f"a{name[0]}"), F.col("below").alias(f"b{name[0]}"))  # noqa: B023, E731
        color = rest.join(end("src"), ["node", "src"]).join(end("dst"), ["node", "dst"]).groupBy("part").applyInArrow(lambda t: _colored(t, turn), kind)
    return color if parts > 1 else cut(color)


def trimmed(edges: DataFrame) -> DataFrame:
    """edges without loops (node, src, dst) without those at a vertex that none leads to or from."""
    into = edges.select("node", F.col("dst").alias("src")).distinct()
    out_of = edges.select("node", F.col("src").alias("dst")).distinct()
    return edges.join(into, ["node", "src"], "left_semi").join(out_of, ["node", "dst"], "left_semi").select("node", "src", "dst")


def _trim(rest: DataFrame, n: int, rounds: int) -> tuple[DataFrame, int]:
    for _ in range(rounds):
        less = cut(trimmed(rest))
        before, n, rest = n, less.count(), less
        if n > (1 - TRIM_SHARE) * before:
            break
    return rest, n


def _members_alone(key: tuple, t: pa.Table) -> pa.Table:
    """node, comp, key of one graph's components."""
    found = _one(key, t, 0)
    return found.filter(pa.compute.equal(found.column("kind"), 0)).select(["node", "comp", "other"]).rename_columns(["node", "comp", "key"])


def components(edges: DataFrame, part_edges: int = GROUP_EDGES) -> DataFrame:
    """node, comp (least key), key of the recurrent components.

    Each turn trims, ends graphs of which at most part_edges edges are left, and gives the other vertices priorities and sends them both ways until nothing changes: a vertex knows the highest one that
    reaches it and the highest one that it reaches. Where both are the same, the vertex is in that one's component;
    vertices that differ in either aren't in one component, so edges between them go. What is left is given other priorities.
    A task sends colours along its part's edges as far as they lead; between such rounds vertices take the highest colours of all
    parts, by an aggregation and joins.
    """
    edges = cut(edges.select("node", "src", "dst").distinct())
    loops = edges.filter("src = dst").select("node", F.col("src").alias("comp"), F.col("src").alias("key"))
    rest, found = edges.filter("src != dst"), []
    n = rest.count()
    for turn in range(64):
        rest, n = _trim(rest, n, TRIM_ROUNDS if turn == 0 else 1) if n > part_edges else (rest, n)
        sizes = rest.groupBy("node").count()
        most = sizes.agg(F.max("count")).first()[0] or 0
        large = cut(sizes.filter(F.col("count") > part_edges).select("node")) if most > part_edges else None
        small = rest.join(large, "node", "left_anti") if large else rest
        found.append(cut(small.groupBy("node").applyInArrow(_members_alone, "node long, comp long, key long")))
        if large is None:
            break
        rest = rest.join(large, "node", "left_semi")
        parts = -(-n // part_edges)
        rest = _in_parts(rest, parts)
        mine = _colors(rest, parts, turn).withColumn("done", F.col("above") == F.col("below"))
        group = mine.filter("done")
        named = group.groupBy("node", "above").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("comp")).filter("n > 1")
        found.append(cut(group.join(named, ["node", "above"]).select("node", "comp", "key")))
        left = mine.filter(~F.col("done"))
        side = lambda name: left.select("node", F.col("key").alias(name), "above", "below")  # noqa: B023, E731
        rest = cut(rest.join(side("src"), ["node", "src"]).join(side("dst"), ["node", "dst", "above", "below"]).select("node", "src", "dst"))
        n = rest.count()
    else:
        raise RuntimeError("the components didn't settle")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.unionByName(loops.join(out.select("node", "key"), ["node", "key"], "left_anti").select("node", "comp", "key"))


def _words(left: pa.Table, right: pa.Table) -> pa.Table:
    """A part's edges (node, src, dst) and the words known of their ends (node, key, word, bits). The words of vertices that got further bits, as far as
    these edges lead."""
    node, src, dst = (left.column(c).to_numpy() for c in ("node", "src", "dst"))
    ends = np.stack([np.r_[node, node, right.column("node").to_numpy()], np.r_[src, dst, right.column("key").to_numpy()]], 1)
    vertices, flat = np.unique(ends, axis=0, return_inverse=True)
    flat = flat.reshape(-1)
    s, d, of = flat[: len(src)], flat[len(src) : 2 * len(src)], flat[2 * len(src) :]
    words, place = np.unique(right.column("word").to_numpy(), return_inverse=True)
    held = np.zeros((len(vertices), len(words)), np.uint64)
    held[of, place] = right.column("bits").to_numpy().view(np.uint64)
    given, order = held.copy(), np.argsort(s, kind="stable")
    s, d, changed = s[order], d[order], held.any(1)
    while changed.any():
        own, to = s[changed[d]], d[changed[d]]
        starts = np.flatnonzero(np.r_[True, np.diff(own) != 0]) if len(own) else np.zeros(0, np.int64)
        changed = np.zeros(len(vertices), bool)
        if len(starts):
            at = own[starts]
            best = held[at] | np.bitwise_or.reduceat(held[to], starts, axis=0)
            changed[at] = (best != held[at]).any(1)
            held[at] = best
    row, word = np.nonzero(held != given)
    return pa.table({"node": vertices[row, 0], "key": vertices[row, 1], "word": words[word].astype(np.int32), "bits": held[row, word].view(np.int64)})


def reached(edges: DataFrame, members: DataFrame, part_edges: int = GROUP_EDGES) -> DataFrame:
    """node, comp, other: which components are reached from which, each from itself too.

    Components are single vertices of the condensed graph and have a bit each. A vertex's words are the bits that its edges lead to; a task takes
    a part of the edges, a range of keys, and a block of words, and goes on as far as its edges lead. Words of all parts are joined
    by an aggregate (bit_or) until none changes, so there are as many rounds as a way crosses parts.
    """
    named = cut(members.select("node", "key", "comp"))
    comps = named.select("node", "comp").distinct().withColumn("bit", F.row_number().over(Window.partitionBy("node").orderBy("comp")) - 1)
    comps = cut(comps.withColumn("word", F.shiftright("bit", 6)).withColumn("bits", F.expr("shiftleft(1L, bit & 63)")))
    ends = edges.join(named.select("node", F.col("key").alias("src"), F.col("comp").alias("s")), ["node", "src"], "left").join(named.select("node", F.col("key").alias("dst"), F.col("comp").alias("d")), ["node", "dst"], "left")
    every = cut(ends.select("node", F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst")).filter("src != dst").distinct())
    parts = max(1, -(-every.count() // part_edges))
    rest = _in_parts(every, parts)
    most = comps.agg(F.max("word")).first()[0]
    blocks = int(most or 0) // BLOCK_WORDS + 1
    there = cut(rest.select("node", F.explode(F.array("src", "dst")).alias("key"), "part").distinct())
    asked = rest if blocks == 1 else rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["part"] if blocks == 1 else ["part", "block"]
    state, total = comps.select("node", F.col("comp").alias("key"), "word", "bits"), None
    while most is not None:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "key", "word", "bits").cast("decimal(38,0)"))).first()
        if now == total:
            break
        total = now
        known = state.join(there, ["node", "key"]).withColumn("block", F.floor(F.col("word") / BLOCK_WORDS).cast("int"))
        further = asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(lambda left, right: _words(left, right), "node long, key long, word int, bits long")
        state = cut(state.unionByName(further).groupBy("node", "key", "word").agg(F.bit_or("bits").alias("bits")))
        if parts == 1:
            break
    own = state.join(comps.select("node", F.col("comp").alias("key")), ["node", "key"], "left_semi")
    one = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(F.lit(1).cast("long")) == 1))
    pairs = own.select("node", F.col("key").alias("comp"), "word", one.alias("at")).withColumn("bit", F.col("word") * 64 + F.col("at"))
    return pairs.join(comps.select("node", "bit", F.col("comp").alias("other")), ["node", "bit"]).select("node", "comp", "other")


def recurrence(edges: DataFrame, part_edges: int = GROUP_EDGES) -> tuple[DataFrame, DataFrame]:
    """members (node, comp, key) and reach (node, comp, other) of the graphs of all nodes. comp is the component's least key."""
    edges = cut(edges.select("node", "src", "dst").distinct())
    members = cut(components(edges, part_edges))
    return members, cut(reached(edges, members, part_edges))


def recurrence_of_many(edges: DataFrame, group_edges: int = GROUP_EDGES, group_components: int = GROUP_COMPONENTS) -> tuple[DataFrame, DataFrame]:
    """The same, with graphs of at most so many edges in a task each, and what so many components at most reach."""
    seen, found = Observation(), Observation()
    edges = cut(edges.select("node", "src", "dst").observe(seen, F.count(F.lit(1)).alias("edges")))
    large = None
    if seen.get["edges"] > group_edges:
        large = cut(edges.groupBy("node").count().filter(F.col("count") > group_edges).select("node"))
    small = edges.join(large, "node", "left_anti") if large else edges
    both = small.groupBy("node").applyInArrow(lambda key, t: _one(key, t, group_components), "kind int, node long, comp long, other long")
    both = cut(both.observe(found, F.count(F.when(F.col("kind") == 2, 1)).alias("open")))
    members = both.filter("kind = 0").select("node", "comp", F.col("other").alias("key"))
    reach = both.filter("kind = 1").select("node", "comp", "other")
    if found.get["open"]:
        open_ = both.filter("kind = 2").select("node")
        reach = reach.unionByName(reached(edges.join(open_, "node", "left_semi"), members.join(open_, "node", "left_semi"), group_edges))
    if large:
        own, further = recurrence(edges.join(large, "node", "left_semi"), group_edges)
        members, reach = members.unionByName(own), reach.unionByName(further)
    return members, reach


# --- small relations: posets ------------------------------------------------------------------------------------------


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """u, v of a transitively closed relation without the pairs that go through a third one, and without loops."""
    strict = edges.filter("u != v").distinct()
    through = strict.alias("a").join(strict.alias("b"), F.col("a.v") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("b.v").alias("v")).distinct()
    return strict.join(through, ["u", "v"], "left_anti")


def attractors(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(edges.filter("u != v").select(F.col("u").alias("v")).distinct(), "v", "left_anti")


def repellers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(edges.filter("u != v").select("v").distinct(), "v", "left_anti")


def annotated(vertices: DataFrame, notes: DataFrame) -> DataFrame:
    """vertices with notes: the set of each vertex's notes (v, note), ascending; none: an empty array."""
    own = notes.filter("note is not null").groupBy("v").agg(F.sort_array(F.collect_set(F.col("note").cast("string"))).alias("notes"))
    return vertices.drop("notes").join(own, "v", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, key, out_degree, in_degree of all vertices; one shuffle with map-side combine."""
    ends = edges.select("node", F.col("src").alias("key"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("node", "dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node", "key").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def edited(edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """node, src, dst of digraphs without the edges removed and with those added, each once; an edge that is both is there."""
    names = ["node", "src", "dst"]
    out = edges.select(*names)
    out = out if removed is None else out.join(removed.select(*names), names, "left_anti")
    out = out if added is None else out.unionByName(added.select(*names))
    return out.distinct()


def index_pair(edges: DataFrame, members: DataFrame) -> DataFrame:
    """node, comp, key, exit: for each component S the boxes of X = F(S), exit those outside S."""
    image = edges.join(members.withColumnRenamed("key", "src"), ["node", "src"]).select("node", "comp", F.col("dst").alias("key")).distinct()
    return image.join(members.withColumn("__in", F.lit(True)), ["node", "comp", "key"], "left").select("node", "comp", "key", F.col("__in").isNull().alias("exit"))
