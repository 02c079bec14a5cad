"""Near-duplicate detection by SimHash fingerprints and a covering code.

A fingerprint has 64 bits; bit b is 1 if more than half of the text's shingle hashes have it. Two fingerprints link if
they differ in at most BITS bits.

Anchors are the words of a covering code: every fingerprint lies within the code's covering radius R of some anchor,
so two fingerprints at distance d <= BITS have an anchor within R of one and within R + BITS of the other. The code is
a sum of the binary Golay code (23 bits, R = 3, perfect) and of repetition codes (9 bits, R = 4) over disjoint bits.
Each distinct fingerprint is home at its nearest anchor, and visits every anchor at which it is at most BITS further
away than a home may be, summed over the blocks of the code. Homes and visitors are compared per anchor.

Per anchor no pairs are emitted. The homes are held, in slices of at most about SLICE, visitors stream past; a visitor
gives one link for each group of homes that it is the first to join. So a large group of near copies yields as many
links as it has members and not their square, and all links together connect what the pairs would connect. An anchor
with more homes than SLICE is split by a hash of the home, its visitors into parts by a hash of theirs; each part meets each slice.

Nodes are fingerprints. Nulls count as empty texts; a text without words has fingerprint zero and links like any other.
Rows that repeat an id each have the component of their fingerprint, and so has a null id, which is no component's name
while others are there. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynspark.llm.common import cut, survivors, table, text_or_empty
from dynspark.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Homes of an anchor that one task compares with at a time; parts that a hot anchor's visitors are dealt into at most.
SLICE, PARTS = 4096, 16
#: Contents times words of a code that are compared at once, 8 bytes each.
AT_ONCE = 1 << 20
#: Rows of a table of hot anchors that may be broadcast.
BROADCAST_ROWS = 100_000
UPPER = bytes(range(65, 91))
TO_LOWER = bytes.maketrans(UPPER, UPPER.lower())


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().translate(TO_LOWER).split()  # bytes.split(): exactly space and 0x09-0x0D
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[min(shingle, len(words)) :]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = h[k : k + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, digest (of the text), fp (the 64 bits as a long) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["id", "digest", "fp"])

    text, kind = text_or_empty(text_col), docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text")).mapInArrow(work, f"id {kind}, digest long, fp long")


# --- the covering code ------------------------------------------------------------------------------------------------


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The 4096 words of the binary Golay code of 23 bits: multiples of its generator polynomial x^11+x^9+x^7+x^6+x^5+x+1."""
    generator, words = 0b101011100011, np.zeros(1, np.int64)
    for k in range(12):
        words = np.concatenate([words, words ^ (generator << k)])
    return words, np.bitwise_count(words)


class Block:
    """A code over the bits [low, low + width) with covering radius radius: for each of its 2^width contents the anchors by excess."""

    def __init__(self, low: int, width: int):
        self.low, self.width = low, width
        self.words = golay()[0] if width == 23 else np.array([0, (1 << width) - 1], np.int64)
        self.radius = 3 if width == 23 else width // 2

    def content(self, fps: np.ndarray) -> np.ndarray:
        return ((fps.view(np.uint64) >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def near(self, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, anchor number, excess for each anchor within radius + bits of a row's content."""
        rows, anchors, excess = [], [], []
        content = self.content(fps)
        step = max(1, AT_ONCE // len(self.words))
        for k in range(0, len(content), step):
            d = np.bitwise_count(content[k : k + step, None] ^ self.words[None, :]).astype(np.int16)
            r, a = np.nonzero(d <= self.radius + bits)
            rows.append(r + k)
            anchors.append(a)
            excess.append(np.maximum(d[r, a] - self.radius, 0))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return cat(rows, np.int64), cat(anchors, np.int64), cat(excess, np.int16)

    def home(self, fps: np.ndarray) -> np.ndarray:
        content, out = self.content(fps), np.zeros(len(fps), np.int64)
        step = max(1, AT_ONCE // len(self.words))
        for k in range(0, len(content), step):
            out[k : k + step] = np.bitwise_count(content[k : k + step, None] ^ self.words[None, :]).argmin(1)
        return out


def code(n: int) -> list[Block]:
    """More blocks, so more anchors, for more fingerprints; any choice finds the same links."""
    widths = [23, 9, 9] if n <= 1 << 20 else [23, 9, 9, 9, 9] if n <= 1 << 24 else [23, 23, 9, 9]
    return [Block(low, w) for low, w in zip([0, *accumulate(widths)], widths)]


def placed(fps: np.ndarray, blocks: list[Block], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """home anchor of each row; (row, anchor) of each visit. Anchors are numbered across the blocks."""
    home = np.zeros(len(fps), np.int64)
    rows, anchors, excess = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int16)
    for block in blocks:
        home = home * len(block.words) + block.home(fps)
        r, a, e = block.near(fps, bits)
        first = np.searchsorted(r, np.arange(len(fps) + 1))
        times = (first[1:] - first[:-1])[rows]
        left = np.repeat(np.arange(len(rows)), times)
        right = first[rows][left] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        total = excess[left] + e[right]
        ok = total <= bits
        left, right = left[ok], right[ok]
        rows, anchors, excess = rows[left], anchors[left] * len(block.words) + a[right], total[ok]
    return home, rows, anchors


# --- links ------------------------------------------------------------------------------------------------------------


class Homes:
    """The homes of one anchor and slice, in groups by what visitors have connected so far."""

    def __init__(self, homes: np.ndarray, bits: int):
        self.homes, self.bits = homes, bits
        self.group = np.arange(len(homes))

    def meet(self, visitors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(visitor, home) links that connect what all pairs within bits connect: one for each group that a visitor joins."""
        step = max(1, (1 << 21) // len(self.homes))
        for k in range(0, len(visitors), step):
            part = visitors[k : k + step]
            r, h = np.nonzero(np.bitwise_count(part.view(np.uint64)[:, None] ^ self.homes.view(np.uint64)[None, :]) <= self.bits)  # of signed numbers it would count the absolute value's bits
            other = part[r] != self.homes[h]
            r, h = r[other], h[other]
            if not len(r):
                continue
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            yield part[r[first]], self.homes[h[first]]
            groups = self.group[h]
            several = np.flatnonzero(np.minimum.reduceat(groups, first) != np.maximum.reduceat(groups, first))
            last = np.r_[first[1:], len(r)]
            for i in several.tolist():
                own = h[first[i] : last[i]]
                names, at = np.unique(self.group[own], return_index=True)
                if len(names) > 1:
                    yield np.repeat(part[r[first[i]]], len(at)), self.homes[own[at]]
                    self.group[np.isin(self.group, names)] = names[0]


def links(distinct: DataFrame, bits: int = BITS, slice_rows: int = SLICE) -> DataFrame:
    """distinct: fp. Returns fp, other: links that connect all fingerprints at most bits apart."""
    n = distinct.count()
    blocks = code(n)

    def homes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy(np.int64)
            home = np.zeros(len(fps), np.int64)
            for block in blocks:
                home = home * len(block.words) + block.home(fps)
            yield pd.DataFrame({"anchor": home, "fp": fps})

    def visits_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            every = b["fp"].to_numpy(np.int64)
            for k in range(0, len(every), 2000):
                fps = every[k : k + 2000]
                _, rows, anchors = placed(fps, blocks, bits)
                yield pd.DataFrame({"anchor": anchors, "fp": fps[rows]})

    homes = cut(distinct.mapInPandas(homes_of, "anchor long, fp long"))
    hot = homes.groupBy("anchor").count().filter(F.col("count") > slice_rows).select("anchor", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    hot = cut(hot.withColumn("parts", F.least("slices", F.lit(PARTS))))
    visits = distinct.mapInPandas(visits_of, "anchor long, fp long")
    many = hot.count()
    small = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
    if many:
        homes, visits = (x.join(small, "anchor", "left").fillna(1, ["slices", "parts"]) for x in (homes, visits))
        own, every = (lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        homes = homes.withColumn("slice", own("slices")).withColumn("part", every("parts")).drop("slices", "parts")
        visits = visits.withColumn("part", own("parts")).withColumn("slice", every("slices")).drop("slices", "parts")
    else:
        homes, visits = (x.withColumn("slice", F.lit(0)).withColumn("part", F.lit(0)) for x in (homes, visits))
    dealt = homes.withColumn("visits", F.lit(False)).unionByName(visits.withColumn("visits", F.lit(True)))
    dealt = dealt.withColumn("slice", F.col("slice") * PARTS + F.col("part")).select("anchor", "fp", "slice", "visits")
    dealt = dealt.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice", "visits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, homes, held = None, [], None
        for b in batches:
            anchor, fp, part, visit = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            change = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (visit[1:] != visit[:-1])
            starts = np.flatnonzero(np.r_[True, change]).tolist()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, [*starts[1:], len(fp)]):
                key = (anchor[s], part[s])
                if key != at:
                    at, homes, held = key, [], None
                if not visit[s]:
                    homes.append(fp[s:e])
                elif homes:
                    held = held or Homes(np.concatenate(homes), bits)
                    found += held.meet(fp[s:e])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in (0, 1)], ["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def joined(fps: DataFrame, bits: int) -> DataFrame:
    """fps: fp. Returns fp, component (one of its fingerprints) of the fingerprints that are linked to others."""
    return components(links(fps.select("fp").distinct(), bits)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hexadecimal digits), component_id (the least id reachable by links)."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle).drop("digest"))
    least = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    named = least.join(joined(least, bits), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ends = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ends, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs with one document of each component: the one with the least id; null ids come last. Rows are told apart by id
    and text, so of rows that share an id each may stay or go; of equal rows one stays. Columns stay as they are."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    named = fps.join(joined(fps, bits), "fp", "left").select("id", "digest", F.coalesce("component", "fp").alias("component"))
    return survivors(docs, id_col, F.xxhash64(text_or_empty(text_col)), named)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
