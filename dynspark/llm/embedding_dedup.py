"""Near-duplicate vectors by sign hashing in several tables, exact cosines, and distributed components.

Only vectors of one label are compared; a null label, and a null or zero vector or one with null or non-finite
components, links with nothing. Equal vectors of a label are one node, compared once, with the number of its members.

1. A table's hash is the signs of a vector's products with `planes` random directions. Two vectors at the least cosine to
   link agree in one sign with probability p = 1 - arccos(cosine) / pi, in all of a table with p^planes, so the number of
   tables follows from the recall asked for at that cosine; closer pairs are found more surely. `planes` grows with the
   logarithm of the largest label, which keeps buckets small; the recall is the same at any size.
2. To the buckets (label, table, hash) go node and SKETCH more signs, 48 bytes, and no vectors. Pairs of a bucket whose
   sketches differ in at most as many signs as NEARLY of the pairs at the least cosine do are candidates. No
   pair is emitted: a task gives links enough to connect what its candidates connect. Components of these links are
   sets of vectors outside which nothing links; most vectors are in none.
3. A vector goes to its set, once. There all pairs are compared by their exact cosine: each vector's number of links is
   counted and links enough to connect are given, whose components are the result.

Buckets and sets of more than BLOCK vectors are cut into blocks by a hash, and a task compares one pair of blocks, so no
task holds a whole one; small sets share tasks. An empty table gives an empty result. Rows that repeat a vec_id with
equal label and vector are members of one node, with another vector of another. A null id takes part, and is no
component's name while others are there. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynspark.llm.common import cut, table
from dynspark.llm.components import components

COSINE, RECALL, BLOCK, SEED = 0.93, 0.995, 2048, 17
#: Vectors that a bucket of the largest label holds on average; signs of a sketch; standard deviations above the mean of differing signs.
IN_BUCKET, SKETCH, NEARLY = 512, 256, 3.0
#: Rows of a table of hot buckets that may be broadcast.
BROADCAST_ROWS = 100_000


def layout(largest: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(tables, planes) for labels of at most so many vectors."""
    planes = max(3, ceil(log2(max(1, largest) / IN_BUCKET)))
    agree = (1 - acos(cosine) / pi) ** planes
    return max(1, ceil(log(1 - recall) / log(1 - agree))), planes


def most_differing(cosine: float = COSINE) -> int:
    """Signs of two sketches that differ at most, for all but few pairs at that cosine."""
    p = acos(cosine) / pi
    return int(SKETCH * p + NEARLY * sqrt(SKETCH * p * (1 - p)))


def nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """rows: id, key (null if it can't link). members: key, node (a number), least (id), size, label, vec."""
    vec = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col(label_col).isNotNull() & vec.isNotNull() & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"), F.coalesce(usable, F.lit(False)).alias("usable"))
    # -0.0 and 0.0 are one number; the digest stands for the vector in shuffles
    plain = F.transform(F.col("vec").cast("array<double>"), lambda x: F.when(x == 0, 0.0).otherwise(x))
    rows = rows.withColumn("key", F.when(F.col("usable"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), plain.cast("array<string>")), 256)))
    members = rows.filter("usable").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    return rows.select("id", "key"), members.withColumn("node", F.monotonically_increasing_id())


@lru_cache(4)
def directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, n))


def units(vectors: pd.Series) -> np.ndarray:
    vec = np.stack(vectors.to_numpy()).astype(np.float64)
    vec = vec / np.abs(vec).max(1, keepdims=True)
    return vec / np.sqrt((vec * vec).sum(1, keepdims=True))


def hashed(members: DataFrame, tables: int, planes: int) -> DataFrame:
    """members once for each table: bucket, node, sketch."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for dim, same in whole.groupby(whole["vec"].map(len)):
                for k in range(0, len(same), 2000):
                    b = same.iloc[k : k + 2000]
                    signs = units(b["vec"]) @ directions(int(dim), SKETCH + tables * planes) > 0
                    codes = np.packbits(signs[:, SKETCH:].reshape(len(b), tables, planes), axis=2)
                    yield pd.DataFrame({"node": b["node"], "label": b["label"], "dim": int(dim), "sketch": [x.tobytes() for x in np.packbits(signs[:, :SKETCH], axis=1)], "codes": [[c.tobytes() for c in x] for x in codes]})

    label = members.schema["label"].dataType.simpleString()
    out = members.select("node", "label", "vec").mapInPandas(work, f"node long, label {label}, dim int, sketch binary, codes array<binary>")
    return out.select("node", "label", "dim", "sketch", F.posexplode("codes").alias("table", "code")).select(F.xxhash64("label", "dim", "table", "code").alias("bucket"), "node", "sketch")


def in_blocks(rows: DataFrame, by: str, hot: DataFrame) -> DataFrame:
    """rows with side, i, j: what shares by is cut into hot's (by, blocks) blocks, and each pair of blocks (i, j) gets the rows of both."""
    few = hot.count()
    if not few:
        return rows.withColumn("side", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    rows = rows.join(F.broadcast(hot) if few <= BROADCAST_ROWS else hot, by, "left").fillna(1, ["blocks"])
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other", "blocks")


def too_large(rows: DataFrame, by: str, block: int) -> DataFrame:
    return cut(rows.groupBy(by).count().filter(F.col("count") > block).select(by, F.ceil(F.col("count") / block).cast("int").alias("blocks")))


class Joined:
    """Which of n things are connected by the links that were given; keeps those that connect anything new."""

    def __init__(self, n: int):
        self.root, self.us, self.vs = np.arange(n), [], []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        apart = self.root[x] != self.root[y]
        for p, q in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            if self.root[p] != self.root[q]:
                self.us.append(p)
                self.vs.append(q)
                self.root[self.root == self.root[q]] = self.root[p]


def pairs_of(side: np.ndarray, i: int, j: int, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows to compare, some of the one block and all of the other; of one block with itself, those after the first of some."""
    if i != j:
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        yield from ((a[k : k + step], b) for k in range(0, len(a), step))
    else:
        yield from ((np.arange(k, min(k + step, len(side))), np.arange(k, len(side))) for k in range(0, len(side), step))


def candidates(key: tuple, t: pa.Table, most: int) -> pa.Table:
    """Nodes of a bucket, or of two blocks of it: u, v that connect what differs in at most so many signs."""
    i, j = key[1].as_py(), key[2].as_py()
    node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
    found = Joined(len(node))
    if len(node) > 1:
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        for a, b in pairs_of(side, i, j):
            differ = np.zeros((len(a), len(b)), np.uint16)
            for c in range(sketch.shape[1]):
                differ += np.bitwise_count(sketch[a, c][:, None] ^ sketch[b, c][None, :])
            x, y = np.nonzero(differ <= most)
            found.add(a[x], b[y])
    return pa.table({"u": pa.array(node[np.array(found.us, np.int64)], pa.int64()), "v": pa.array(node[np.array(found.vs, np.int64)], pa.int64())})


def compared(key: tuple, t: pa.Table, cosine: float) -> pa.Table:
    """Sets of vectors, or two blocks of one. Rows (u, v, n): n links that u has here; v, if not null, linked to u."""
    i, j = key[2].as_py(), key[3].as_py()
    whole = t.to_pandas()
    node, size = whole["node"].to_numpy(), whole["size"].to_numpy()
    count, found = np.zeros(len(node), np.int64), Joined(len(node))
    for _, rows in whole.groupby(["component", "label", whole["vec"].map(len)], sort=False).indices.items():
        if len(rows) == 1:
            continue
        unit = units(whole["vec"].iloc[rows])
        for a, b in pairs_of(whole["side"].to_numpy()[rows], i, j):
            close = unit[a] @ unit[b].T >= cosine
            if i == j:
                close &= a[:, None] < b[None, :]
            x, y = np.nonzero(close)
            x, y = rows[a[x]], rows[b[y]]
            np.add.at(count, x, size[y])
            np.add.at(count, y, size[x])
            found.add(x, y)
    some, us, vs = np.flatnonzero(count), np.array(found.us, np.int64), np.array(found.vs, np.int64)
    v = pa.array(np.r_[np.zeros(len(some), np.int64), node[vs]], mask=np.r_[np.ones(len(some), bool), np.zeros(len(us), bool)])
    return pa.table({"u": pa.array(np.r_[node[some], node[us]], pa.int64()), "v": v, "n": pa.array(np.r_[count[some], np.zeros(len(us), np.int64)], pa.int64())})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept."""
    rows, members = nodes(vectors, id_col, vec_col, label_col)
    rows, members = cut(rows), cut(members)
    largest = members.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    entries, most = hashed(members, *layout(largest, cosine, recall)), most_differing(cosine)
    dealt = in_blocks(entries, "bucket", too_large(entries, "bucket", block))
    near = dealt.groupBy("bucket", "i", "j").applyInArrow(lambda key, t: candidates(key, t, most), "u long, v long")
    sets = cut(components(near))
    own = members.select("node", "label", "size", "vec").join(sets, "node")
    packs = max(1, sets.count() // block)
    large = too_large(sets, "component", block)
    own = in_blocks(own, "component", large)
    own = own.join(large.select("component", F.col("component").alias("large")), "component", "left")
    own = own.withColumn("pack", F.when(F.col("large").isNull(), F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(0))
    found = own.groupBy("large", "pack", "i", "j").applyInArrow(lambda key, t: compared(key, t, cosine), "u long, v long, n long")
    found = cut(found)
    counts = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    named = members.select("key", "node", "least", "size").join(counts, "node", "left").join(components(found.filter("v is not null").select("u", "v")), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node")).withColumn("n", F.coalesce("n", F.lit(0)) + F.col("size") - 1)
    ends = named.groupBy("component").agg(F.min("least").alias("name"))
    out = rows.join(named.join(ends, "component").select("key", "n", "name"), "key", "left")
    component = F.coalesce("name", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, by brute force.
OP8_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS MATERIALIZED (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM usable),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM normed a JOIN normed b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS least FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN degree d ON d.u = vec_id LEFT JOIN least m ON m.u = vec_id
"""
