"""Hard negatives: for each anchor and each of its nearest rows of the same label, rows of other labels that are nearly as near.

Components become integers, floor(256 x); a score is an exact inner product. Rows are packed in Kronecker's way: a component's values of
CHUNK rows, made non-negative by a bias, are the fields of one wide integer, so a product with an anchor's component (biased
likewise) and a sum over components are one multiplication and one addition each for all rows of the chunk; fields are
wide enough that nothing carries over, and the biases' share is taken off when the sums are unpacked.

Every anchor meets every row, in blocks: anchors and rows are dealt to blocks by a hash, of about CELLS components each whatever the
vectors' length, and a task compares one block of anchors with one of rows. No pair leaves a task but the best ones: at most `positives` rows an
anchor and block in the first pass, `negatives` rows an anchor, positive and block in the second; windows over these choose the result.
Labels are only looked at inside tasks, so a label of a third of all rows costs no task more than another. What is broadcast: nothing.

No part have rows with a null id, label or vector, or with a null or non-finite component. Rows that repeat an id are rows
of their own, anchors as well, and each other's possible positives. Only vectors of one length are compared. Equal scores go by smaller
id. Components so large that a biased sum needs more than 64 bits raise an error (components below 2 and 100,000 of them are far from it).
An empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.llm.common import cut, table

#: Components of a block, about; rows of a wide integer.
CELLS, CHUNK = 1 << 22, 2048
POSITIVES, NEGATIVES, SCALE = 5, 3, 256.0
#: A negative's score is within these per cents of the positive's.
WITHIN = (50, 95)


class Packed:
    """Rows of integer components, packed for anchors whose components are at most `most` in size."""

    def __init__(self, q: np.ndarray, most: int):
        n, dim = q.shape
        self.bias, self.most, self.n = int(np.abs(q).max(initial=0)), most, n
        bound = max(1, dim) * 4 * max(1, self.bias) * max(1, most)
        if bound >= 1 << 64 or self.bias >= 1 << 62 or most >= 1 << 62:
            raise ValueError("scores of such large components need more than 64 bits")
        self.field = np.dtype("<u4" if bound < 1 << 32 else "<u8")
        self.wide = [int.from_bytes((q[:, d] + self.bias).astype(self.field).tobytes(), "little") for d in range(dim)]
        self.sums = q.sum(1)

    def scores(self, a: list[int]) -> np.ndarray:
        """The inner product of a with each row."""
        total = 0
        for x, wide in zip(a, self.wide, strict=True):
            total += (x + self.most) * wide
        fields = np.frombuffer(total.to_bytes(self.n * self.field.itemsize, "little"), self.field).astype(np.uint64)
        share = self.bias * sum(a) + len(a) * self.most * self.bias
        return (fields - np.uint64(share % (1 << 64)) - (self.sums * self.most).astype(np.uint64)).view(np.int64)


def _vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets and components of the column q."""
    q = t.column("q").combine_chunks()
    q = q.chunk(0) if isinstance(q, pa.ChunkedArray) else q
    flat = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.r_[0, np.cumsum(q.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64), flat, q


def _groups(t: pa.Table, by_label: bool) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """(length, label or None) -> numbers of rows, by ascending id, and their components."""
    offsets, flat, _ = _vectors(t)
    size, label, order = np.diff(offsets), t.column("label").to_numpy(), np.lexsort((t.column("row").to_numpy(), t.column("id").to_numpy()))
    out: dict[tuple, list[int]] = {}
    for k in order.tolist():
        out.setdefault((int(size[k]), int(label[k]) if by_label else None), []).append(k)
    return {g: (np.array(rows), flat[offsets[rows][:, None] + np.arange(g[0])]) for g, rows in out.items()}


def _packs(q: np.ndarray, most: int) -> Iterator[tuple[int, Packed]]:
    for k in range(0, len(q), CHUNK):
        yield k, Packed(q[k : k + CHUNK], most)


def nearest(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Of each anchor (left) the k best rows of the same label among right: anchor, score, id, row."""
    row, ids, own = right.column("row").to_numpy(), right.column("id").to_numpy(), left.column("row").to_numpy()
    rows_of, best = _groups(right, True), {}
    for g, (anchors, qa) in _groups(left, True).items():
        if g not in rows_of:
            continue
        rows, q = rows_of[g]
        for at, pack in _packs(q, int(np.abs(qa).max(initial=0))):
            here = rows[at : at + CHUNK]
            for a, vec in zip(anchors.tolist(), qa.tolist(), strict=True):
                s = pack.scores(vec)
                other = np.flatnonzero(row[here] != own[a])
                top = other[np.argsort(-s[other], kind="stable")[:k]]
                found = [(-int(s[x]), int(ids[here[x]]), int(row[here[x]])) for x in top.tolist()]
                best[a] = sorted(best.get(a, []) + found)[:k]
    flat = [(int(own[a]), -s, i, r) for a, found in best.items() for s, i, r in found]
    return pa.table({name: pa.array([x[c] for x in flat], pa.int64()) for c, name in enumerate(("anchor", "score", "id", "row"))})


def window(left: pa.Table, right: pa.Table, k: int, within: tuple[int, int]) -> pa.Table:
    """Of each anchor (left, with the scores of its positives) and positive the k best rows of other labels among right whose score is in
    the window: anchor, place (which positive), score, id."""
    label, ids, own, mine = right.column("label").to_numpy(), right.column("id").to_numpy(), left.column("row").to_numpy(), left.column("label").to_numpy()
    positives, rows_of = left.column("scores").to_pylist(), _groups(right, False)
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for g, (anchors, qa) in _groups(left, False).items():
        if g not in rows_of:
            continue
        rows, q = rows_of[g]
        for at, pack in _packs(q, int(np.abs(qa).max(initial=0))):
            here = rows[at : at + CHUNK]
            for a, vec in zip(anchors.tolist(), qa.tolist(), strict=True):
                s = pack.scores(vec)
                ends = [(-(-within[0] * p // 100), within[1] * p // 100) for p in positives[a]]
                high = max(hi for _, hi in ends)
                other = np.flatnonzero((s <= high) & (label[here] != mine[a]))
                falling = other[np.argsort(-s[other], kind="stable")]
                down = -s[falling]
                for place, (lo, hi) in enumerate(ends):
                    first = int(np.searchsorted(down, -hi, "left"))
                    found = [(-int(s[x]), int(ids[here[x]])) for x in falling[first : first + k].tolist() if s[x] >= lo]
                    if found:
                        best[a, place] = sorted(best.get((a, place), []) + found)[:k]
    flat = [(int(own[a]), place, -s, i) for (a, place), found in best.items() for s, i in found]
    return pa.table({name: pa.array([x[c] for x in flat], pa.int64()) for c, name in enumerate(("anchor", "place", "score", "id"))})


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """row, id, label, q of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).filter(~F.exists("vec", bad))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("vec", lambda x: F.floor(x * SCALE).cast("long")).alias("q")))


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, within: tuple[int, int] = WITHIN, cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: which rows are (a condition on id); label: each row's."""
    rows = quantised(vectors, id_col, vec_col, label)
    anchors = rows.filter(anchor).toDF(*rows.columns)
    total = lambda df: df.agg(F.sum(F.size("q"))).first()[0] or 0
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    few, many = max(1, -(-total(anchors) // cells)), max(2 * parallel, -(-total(rows) // cells))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(int(n))).cast("int")
    there = rows.select("*", block(many).alias("j")).withColumn("i", every(few)).groupBy("i", "j")
    met = lambda own, work, kind: own.select("*", block(few).alias("i")).withColumn("j", every(many)).groupBy("i", "j").cogroup(there).applyInArrow(work, kind)

    ranked = lambda df, by, k, *more: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", *more))).filter(F.col("rank") <= k)
    near = ranked(met(anchors, lambda left, right: nearest(left, right, positives), "anchor long, score long, id long, row long"), ["anchor"], positives, "row")
    near = cut(near.select("anchor", (F.col("rank") - 1).alias("place"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))
    held = near.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asking = anchors.join(held.withColumnRenamed("anchor", "row"), "row").toDF("row", "id", "label", "q", "scores")
    found = met(asking, lambda left, right: window(left, right, negatives, within), "anchor long, place long, score long, id long")
    found = ranked(found, ["anchor", "place"], negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = found.join(near, ["anchor", "place"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


#: All anchors with all rows.
OP12_SQL = """
WITH own AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256e0)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.r AS anchor, a.id AS anchor_id, b.r AS r, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM own a JOIN own b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.id % 50 = 0),
positive AS (SELECT anchor, anchor_id, r, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, r) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 3
"""
