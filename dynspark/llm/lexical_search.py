"""Ranked lexical search turned round: the items' inverted index stays put, and documents stream through it.

1. Items become terms and their numbers (`postings`). They are taken in groups of at most about MOST_POSTINGS postings and MOST_ITEMS items, dealt by a
   hash; a group's index is what is broadcast, so its size is bounded whatever the table is, and each group is a pass over the documents.
   A group that is larger all the same (one item of millions of different terms) raises an error.
2. A document becomes its number of terms and the counts of those that an item has, in numpy, for a block of bytes at a time; this
   small table is written to the shared folder. The numbers of documents and terms, and of documents of each term, are aggregates over all of it.
3. Each task streams its documents' counts through the index, adds up scores in 64-bit integers for all items that share a term
   with them, and keeps a heap of the best `top` documents for each item. Heaps are merged in two steps, by item and a hash first.

Terms are runs of ASCII letters and digits and all other characters beyond ASCII, A-Z in lower case. A null or empty text has no terms
and counts as no document; a null or empty item has no results. A very long text is read in blocks, whole. Rows that
repeat an id are documents, or items, of their own, and their rows in the result too. Equal scores go by ascending id, a null id last. Empty tables
give an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.llm.common import SHORT, mixed, shared_dir, short_keys, table, text_or_empty

#: Postings (item, term) and items of a group at most, about; an index of twice as much is an error.
MOST_POSTINGS, MOST_ITEMS = 2_000_000, 8192
#: Bytes of texts that are cut into terms at a time; documents and cells of a matrix of scores; parts in which heaps are merged first.
BLOCK, STEP, CELLS, SPREAD = 1 << 22, 512, 1 << 21, 64
TOP = 20

#: Which bytes of UTF-8 belong to terms, and what they are in lower case.
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
IN_TERM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | _UPPER | ((_BYTES >= 97) & (_BYTES <= 122))
LOWER = (_BYTES + np.where(_UPPER, 32, 0)).astype(np.uint8)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together and where each begins (and the last one ends)."""
    texts = texts.cast(pa.large_string())
    where, data = texts.buffers()[1:]
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Parts of about size bytes that end with a text or outside a term."""
    begin, last = 0, len(data)
    while begin < last:
        end = min(begin + size, last)
        if end < last:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > begin:
                end = int(offsets[k])
            else:
                outside = np.flatnonzero(~IN_TERM[data[begin:end]])
                if len(outside):
                    end = begin + int(outside[-1]) + 1
                else:  # a term of more than size bytes: up to its end
                    stop = int(offsets[k + 1])
                    while end < stop and IN_TERM[data[end]]:
                        more = np.flatnonzero(~IN_TERM[data[end : min(end + size, stop)]])
                        end = end + int(more[0]) if len(more) else min(end + size, stop)
        yield begin, end
        begin = end


def terms(data: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the block: its bytes in lower case; where terms begin in it; their lengths; the texts that they are of."""
    part = data[begin:end]
    inside = IN_TERM[part]
    first = np.zeros(len(part) + 1, bool)  # a text begins here
    cuts = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end)] - begin
    first[cuts] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (first[1:] | ~np.r_[inside[1:], False])) + 1
    return LOWER[part], starts, ends - starts, np.searchsorted(offsets, starts + begin, "right") - 1


class Terms:
    """Numbers of known terms: short ones by two numbers that hold their bytes, long ones by a dictionary."""

    def __init__(self, known: list[bytes]):
        self.n = len(known)
        short = np.array([k for k, t in enumerate(known) if len(t) <= SHORT], np.int64)
        data = np.frombuffer(b"".join(known[k] for k in short), np.uint8)
        lengths = np.array([len(known[k]) for k in short], np.int64)
        a, b = short_keys(data, np.cumsum(lengths) - lengths, lengths)
        self.salt = np.uint64(0)
        while len(np.unique(self._hash(a, b))) < len(short):
            self.salt += np.uint64(1)
        order = np.argsort(self._hash(a, b))
        self.hashes, self.a, self.b, self.number = self._hash(a, b)[order], a[order], b[order], short[order]
        self.long = {t: k for k, t in enumerate(known) if len(t) > SHORT}
        self.lengths = np.unique(np.array([len(t) for t in self.long], np.int64))

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(a ^ mixed(b + self.salt))

    def numbers(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for unknown ones."""
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(lengths <= SHORT)
        if len(short) and len(self.hashes):
            a, b = short_keys(data, starts[short], lengths[short])
            at = np.minimum(np.searchsorted(self.hashes, self._hash(a, b)), len(self.hashes) - 1)
            out[short] = np.where((self.a[at] == a) & (self.b[at] == b), self.number[at], -1)
        if self.long:
            raw = data.tobytes() if (rest := np.flatnonzero(np.isin(lengths, self.lengths))).size else b""
            for k in rest.tolist():
                out[k] = self.long.get(raw[starts[k] : starts[k] + lengths[k]], -1)
        return out


def counted(texts: pa.Array, known: Terms, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of terms of each text; text, term and count of the known ones in them, in order."""
    data, offsets = bytes_of(texts)
    n, keys, counts = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end in blocks(data, offsets, block):
        low, starts, lengths, text = terms(data, offsets, begin, end)
        n += np.bincount(text, minlength=len(texts))
        number = known.numbers(low, starts, lengths)
        key, count = np.unique((text * known.n + number)[number >= 0], return_counts=True)
        keys.append(key)
        counts.append(count)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, place, np.concatenate(counts))
    return n, key // max(1, known.n), key % max(1, known.n), count


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, item -> row, terms, counts."""
    for b in batches:
        found: list[dict[bytes, int]] = [{} for _ in range(len(b))]
        data, offsets = bytes_of(b.column(1))
        for begin, end in blocks(data, offsets, BLOCK):
            low, starts, lengths, text = terms(data, offsets, begin, end)
            raw = low.tobytes()
            for s, size, t in zip(starts.tolist(), lengths.tolist(), text.tolist(), strict=True):
                found[t][raw[s : s + size]] = found[t].get(raw[s : s + size], 0) + 1
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(x) for x in found], pa.list_(pa.binary())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))], ["row", "terms", "counts"])


class Index:
    """Postings of a group of items by term: items (places in rows) and how often the term is in each."""

    def __init__(self, found: list):
        self.rows = np.array([r["row"] for r in found], np.int64)
        self.known = sorted({bytes(t) for r in found for t in r["terms"]})
        number = {t: k for k, t in enumerate(self.known)}
        term = np.array([number[bytes(t)] for r in found for t in r["terms"]], np.int64)
        item = np.repeat(np.arange(len(found)), [len(r["terms"]) for r in found])
        order = np.lexsort((item, term))
        self.item, self.times = item[order], np.array([c for r in found for c in r["counts"]], np.int64)[order]
        self.begin = np.searchsorted(term[order], np.arange(len(self.known) + 1))


class Heaps:
    """The best k documents of each of n items: score, and id or none."""

    def __init__(self, n: int, k: int):
        self.k, self.item, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.id, self.none, self.least = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(n, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """scores: a row a document, a column an item. Nothing of score 0 or below an item's least one comes in."""
        row, item = np.nonzero((scores > 0) & (scores >= self.least))
        item, score = np.r_[self.item, item], np.r_[self.score, scores[row, item]]
        doc, gone = np.r_[self.id, ids[row]], np.r_[self.none, none[row]]
        order = np.lexsort((doc, gone, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        kept = order[place < self.k]
        self.item, self.score, self.id, self.none = item[kept], score[kept], doc[kept], gone[kept]
        full = order[place == self.k - 1]
        self.least[item[full]] = score[full]


def scores(term: np.ndarray, count: np.ndarray, doc: np.ndarray, m: np.ndarray, weight: np.ndarray, index: Index) -> np.ndarray:
    """Documents by items."""
    value = weight[term] * (1_000_000_000 * count // (1000 * count + 12 * m[doc]))
    many = index.begin[term + 1] - index.begin[term]
    ends = np.cumsum(many)
    at = np.repeat(index.begin[term] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = np.zeros(len(m) * len(index.rows), np.int64)
    np.add.at(out, np.repeat(doc * len(index.rows), many) + index.item[at], np.repeat(value, many) * index.times[at])
    return out.reshape(len(m), len(index.rows))


def _best(docs: DataFrame, index: Index, id_col: str, text_col: str, top: int) -> DataFrame:
    """row (of the item), id, score of each item's best documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(shared.value.known)
        for b in batches:
            n, doc, term, times = counted(b.column(1), known)
            ends = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, x.astype(kind)) for x, kind in ((term, np.int32), (times, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], ["id", "n", "terms", "counts"])

    folder = f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}"
    kind = "id long, n long, terms array<int>, counts array<long>"
    docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col)).mapInArrow(count, kind).filter("n > 0").write.parquet(folder)
    held = spark.read.schema(kind).parquet(folder)
    known = held.select(F.count(F.lit(1)), F.sum("n")).first()
    total, length = int(known[0]), int(known[1] or 0)
    weight = np.zeros(len(index.known), np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many rows as the index has terms
        weight[r["term"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["count"] + 1)))
    weights, items = spark.sparkContext.broadcast(weight), len(index.rows)
    step = max(1, min(STEP, CELLS // max(1, items)))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = shared.value, Heaps(items, top)
        for whole in batches:
            for k in range(0, len(whole), step):
                b = whole.slice(k, step)
                m = np.array([75 + 25 * n * total // length for n in b.column(1).to_pylist()], np.int64)
                doc = np.repeat(np.arange(len(b)), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
                term, times = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                none = b.column(0).is_null().to_numpy(zero_copy_only=False)
                best.add(scores(term, times, doc, m, weights.value, own), b.column(0).fill_null(0).to_numpy(zero_copy_only=False), none)
        yield pa.RecordBatch.from_arrays([pa.array(own.rows[best.item]), pa.array(best.id, mask=best.none), pa.array(best.score)], ["row", "id", "score"])

    return held.select("id", "n", "terms", "counts").mapInArrow(stream, "row long, id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, most_postings: int = MOST_POSTINGS, most_items: int = MOST_ITEMS) -> DataFrame:
    """item_col, rank, id_col, score of the best documents of each item."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), text_or_empty(item_text).alias("text")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    rows.select("row", "text").mapInArrow(item_terms, "row long, terms array<binary>, counts array<long>").filter(F.size("terms") > 0).write.parquet(f"{folder}/terms")
    own = spark.read.parquet(f"{folder}/terms")
    size = own.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    groups = max(1, -(-int(size[0]) // most_items), -(-int(size[1] or 0) // most_postings))
    found = None
    for g in range(groups):
        part = own.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g)
        if (part.agg(F.sum(F.size("terms"))).first()[0] or 0) > 2 * most_postings:
            raise ValueError(f"an index of more than {2 * most_postings} postings isn't broadcast: an item has too many terms")
        best = _best(docs, Index(part.collect()), id_col, text_col, top)
        found = best if found is None else found.unionByName(best)
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    for by in (["row", F.pmod(F.xxhash64("id", "score"), F.lit(SPREAD))], ["row"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return found.join(rows.select("row", "item"), "row").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = f"""
WITH every AS MATERIALIZED (SELECT r, doc_id, {_TERMS.format("text")} AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
asked AS MATERIALIZED (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, {_TERMS.format("text")} AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY ALL),
size AS MATERIALIZED (SELECT r, count(*) AS n FROM every GROUP BY r),
corpus AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM every WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, nn),
part AS MATERIALIZED (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))) AS value FROM tf JOIN weight USING (term) JOIN size USING (r), corpus),
score AS (SELECT i, item_id, r, doc_id, CAST(sum(value * times) AS BIGINT) AS score FROM part JOIN asked USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0
WINDOW w AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER w <= 20
"""
