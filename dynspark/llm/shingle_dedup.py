"""Near-duplicate detection by the Jaccard similarity of shingle sets: pairs at or above 4/5, found by SimHash, decided exactly.

A text is the set of its shingles of SHINGLE words (words and lower case as in simhash), each a 64-bit hash. A pair links
if the sets have at least 4/5 of their union in common. Texts with equal sets are one node, named by a hash of the set.
At that similarity fingerprints of 64 bits differ in 4 to 17, more than a covering code carries at bearable cost; so pairs are sought in two ways:

0. SimHash and covering code, as in simhash.py: nodes whose fingerprints of 64 bits differ in at most 3 are candidates. The next
   two steps are for the pairs that differ in more.
1. Prefix filter. In any order of all shingles, two sets of that similarity share one among the first n // 5 + 1 of
   each, n being a set's size. The order here is: rare ones by hash, then those that are frequent in a sample of the
   texts by how frequent they are, so that repeated lines make no long lists. The sample changes costs, never links.
2. Lists of one shingle that only one node has are left out. Nodes carry a SimHash fingerprint of 128 bits; nodes of a list
   that differ in at most BITS of them are candidates (at similarity 4/5 they differ in 19 on average, with a deviation of 4).
   No pair is emitted: a task gives links enough to connect what its candidates connect. Components of these links are
   sets of nodes outside which nothing links.
3. A node's shingles go to its set, once. There pairs are compared by their shingles; pairs that others connect already are
   passed over, and links enough to connect are given. Their components are the result; of each the least id stays.

Lists and sets of more than BLOCK nodes are cut into blocks by a hash, and a task compares one pair of blocks; small sets share tasks.
A set of many nodes that are alike to few of the others costs the square of its size in comparisons, spread over its pairs of blocks.

Nulls count as empty texts; texts without words are equal to each other, and one of less than SHINGLE words is a single
shingle. A null id is greater than any other. One row of each component stays, also where rows repeat an id, a text or
both. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dynspark.llm import simhash
from dynspark.llm.common import cut, mixed, spans, survivors, text_or_empty
from dynspark.llm.components import components
from dynspark.llm.embedding_dedup import Joined, candidates, in_blocks, pairs_of, too_large
from dynspark.llm.simhash import SEED, TO_LOWER

SHINGLE = 5
#: Texts of the sample; a shingle in more than RARE of them is frequent; how many of those are told to the tasks.
SAMPLE, RARE, FREQUENT = 20_000, 3, 1 << 17
#: Nodes of a block.
BLOCK = 2048
#: Bits of 128 in which nodes may differ.
BITS = 44
#: Rows of a table of digests that may be broadcast.
BROADCAST_ROWS = 500_000
FACTOR, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def shingles(text: str) -> np.ndarray:
    """The set of a text's shingles, as sorted longs; [0] if it has no words."""
    words = text.encode().translate(TO_LOWER).split()
    if not words:
        return np.zeros(1, np.int64)
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(w, SEED) for w in words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * FACTOR
        out ^= out >> SHIFT
    return np.unique(out.view(np.int64))


def simhash128(own: np.ndarray) -> tuple[int, int]:
    """Two longs: a bit is 1 if more than half of the shingles' hashes have it; the second ones are made of the first."""
    h = own.view(np.uint64)
    bits = np.concatenate([h, mixed(h)]).reshape(2, -1).T.copy().view(np.uint8).reshape(len(h), 16)
    counts = np.zeros(128, np.int64)
    for k in range(0, len(bits), 1 << 14):
        counts += np.unpackbits(bits[k : k + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    a, b = np.packbits(counts * 2 > len(h)).view(np.int64).tolist()
    return a, b


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 4/5."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def frequent(texts: DataFrame, n: int) -> np.ndarray:
    """texts: one column. The shingles in more than RARE texts of a sample, the least frequent first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 100):
                sets = [shingles(t.as_py()) for t in b.column(0).slice(k, 100)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["token"])

    some = texts if n <= SAMPLE else texts.sample(SAMPLE / n, 11)
    counts = some.mapInArrow(work, "token long").groupBy("token").count().filter(F.col("count") > RARE)
    top = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas()
    return top["token"].to_numpy(np.int64)[::-1]


def nodes(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """docs: id, digest, text. Returns id, digest, node, size, prefix, fp0, fp1 of each row."""
    by = np.argsort(order)
    shared = docs.sparkSession.sparkContext.broadcast((order[by], by + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks = shared.value
        for b in batches:
            node, size, prefix, fps = [], [], [], []
            for t in b.column(2):
                own = shingles(t.as_py())
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                size.append(len(own))
                fps.append(simhash128(own))
                rank = np.zeros(len(own), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    rank = np.where(names[at] == own, ranks[at], 0)
                prefix.append(own[np.lexsort((own, rank))[: len(own) // 5 + 1]])
            ends = pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            columns = [b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), lists, *(pa.array([x[k] for x in fps], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "node", "size", "prefix", "fp0", "fp1"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "digest", "text").mapInArrow(work, f"id {kind}, digest long, node long, size int, prefix array<long>, fp0 long, fp1 long")


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by token and node: one row for each of them, of tokens that several nodes have."""
    last: tuple = (None, None)  # token, node
    held = None  # the first row of a list as long as it has only one node
    for b in batches:
        token, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(token):
            continue
        fresh = np.r_[token[0] != last[0], token[1:] != token[:-1]]
        again = ~fresh & np.r_[node[0] == last[1], node[1:] == node[:-1]]
        follows, group = ~fresh & ~again, np.cumsum(fresh)
        first = fresh & np.isin(group, group[follows])
        starts = np.flatnonzero(fresh)
        if held is not None:
            if follows[: starts[0] if len(starts) else len(token)].any():
                yield held
                held = None
            elif len(starts):
                held = None
        if len(starts) and not first[starts[-1]]:
            held = b.slice(int(starts[-1]), 1)
        last = (token[-1], node[-1])
        keep = follows | first
        if keep.any():
            yield b.filter(pa.array(keep))


def in_lists(batches: Iterator[pa.RecordBatch], most: int, block: int) -> Iterator[pa.RecordBatch]:
    """Sorted by token: LIST. u, v that connect the nodes of lists of at most block nodes which differ in at most so many bits."""
    at, held, n = None, [], 0
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []

    def settle() -> None:
        if 1 < n <= block:
            node, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            found = Joined(n)
            for x, y in pairs_of(np.zeros(n, np.int64), 0, 0):
                differ = np.bitwise_count(fps[x][:, None, :] ^ fps[y][None, :, :]).sum(2, dtype=np.uint16)
                p, q = np.nonzero(differ <= most)
                found.add(x[p], y[q])
            if found.us:
                us.append(node[np.array(found.us)])
                vs.append(node[np.array(found.vs)])

    for b in batches:
        token, node, fps = b.column(0).to_numpy(), b.column(1).to_numpy(), np.stack([b.column(k).to_numpy() for k in (3, 4)], 1).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]).tolist() if len(token) else []
        for i, j in zip(starts, [*starts[1:], len(token)], strict=True):
            if token[i] != at:
                settle()
                at, held, n = token[i], [], 0
            n += j - i
            if n <= block:
                held.append((node[i:j], fps[i:j]))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])
            us.clear()
            vs.clear()
    settle()
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])


LIST = ("token", "node", "size", "fp0", "fp1")


def lists(rows: DataFrame) -> DataFrame:
    """Of nodes(): LIST, sorted by token in each partition, for tokens that several nodes have."""
    every = rows.select("node", "size", F.explode("prefix").alias("token"), "fp0", "fp1").select(*LIST)
    dealt = every.repartition("token").sortWithinPartitions("token", "node")
    return dealt.mapInArrow(shared, "token long, node long, size int, fp0 long, fp1 long")


def compared(key: tuple, t: pa.Table) -> pa.Table:
    """Sets of nodes with their shingles, or two blocks of one. u, v that connect those that are alike."""
    i, j = key[2].as_py(), key[3].as_py()
    node, side, component = (t.column(c).to_numpy() for c in ("node", "side", "component"))
    own = t.column("own").combine_chunks()
    found = Joined(len(node))
    order = np.argsort(component, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
        sets = [np.frombuffer(own[k].as_buffer(), np.int64) for k in rows.tolist()]
        sizes = np.array([len(x) for x in sets])
        tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(tokens), bool)
        for part, others in pairs_of(side[rows], i, j):
            for x in part.tolist():
                y = others[others > x] if i == j else others
                y = y[found.root[rows[y]] != found.root[rows[x]]]
                y = y[(5 * np.minimum(sizes[y], sizes[x]) >= 4 * np.maximum(sizes[y], sizes[x]))]
                if not len(y):
                    continue
                mine = flat[starts[x] : starts[x] + sizes[x]]
                mark[mine] = True
                n = sizes[y]
                common = np.add.reduceat(mark[flat[spans(starts[y], n)]], np.cumsum(n) - n, dtype=np.int64)
                mark[mine] = False
                y = y[9 * common >= 4 * (n + sizes[x])]
                found.add(np.full(len(y), rows[x]), rows[y])
    us, vs = np.array(found.us, np.int64), np.array(found.vs, np.int64)
    return pa.table({"u": pa.array(node[us], pa.int64()), "v": pa.array(node[vs], pa.int64())})


def close(rows: DataFrame) -> DataFrame:
    """rows: nodes(). u, v that connect the nodes whose SimHash fingerprints (fp0) the covering code links, or are the same."""
    own = cut(rows.select("node", F.col("fp0").alias("fp")).distinct())
    named = cut(own.join(simhash.joined(own, simhash.BITS), "fp", "left").select("node", F.coalesce("component", "fp").alias("group")))
    first = named.groupBy("group").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return named.join(first, "group").filter("node != v").select(F.col("node").alias("u"), "v")


def links(rows: DataFrame, texts: DataFrame, most: int = BITS, block: int = BLOCK) -> DataFrame:
    """rows: nodes(). texts: digest, text of all rows. u, v: links between nodes that are alike; they connect all that are."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["node", "own"])

    listed = cut(lists(rows))
    near = listed.mapInArrow(lambda b: in_lists(b, most, block), "u long, v long")
    long = too_large(listed, "token", block)
    if not long.isEmpty():
        sketch = F.concat(F.unhex(F.lpad(F.hex("fp0"), 16, "0")), F.unhex(F.lpad(F.hex("fp1"), 16, "0")))
        own = in_blocks(listed.join(long.select("token"), "token", "left_semi").select("token", "node", sketch.alias("sketch")), "token", long)
        near = near.unionByName(own.groupBy("token", "i", "j").applyInArrow(lambda key, t: candidates(key, t, most), "u long, v long"))
    found = cut(components(near.unionByName(close(rows))))
    picked = cut(rows.join(found, "node").groupBy("node").agg(F.min("digest").alias("digest"), F.first("component").alias("component")))
    n = picked.count()
    one = texts.join(F.broadcast(picked.select("node", "digest")) if n <= BROADCAST_ROWS else picked.select("node", "digest"), "digest")
    own = one.dropDuplicates(["node"]).select("node", "text").mapInArrow(sets_of, "node long, own binary").join(picked.select("node", "component"), "node")
    large = too_large(picked, "component", block)
    own = in_blocks(own, "component", large).join(large.select("component", F.col("component").alias("large")), "component", "left")
    own = own.withColumn("pack", F.when(F.col("large").isNull(), F.pmod(F.xxhash64("component"), F.lit(max(1, n // block)))).otherwise(0))
    return cut(own.groupBy("large", "pack", "i", "j").applyInArrow(compared, "u long, v long"))


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the least id. Columns stay as they are."""
    digest = F.xxhash64(text_or_empty(text_col))
    texts = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), text_or_empty(text_col).alias("text"))
    order = frequent(texts.select("text"), docs.count())
    rows = cut(nodes(texts, order))
    named = rows.join(components(links(rows, texts.select("digest", "text"))), "node", "left")
    return survivors(docs, id_col, digest, named.select("id", "digest", F.coalesce("component", "node").alias("component")))
