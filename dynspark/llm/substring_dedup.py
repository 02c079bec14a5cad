"""Removal of passages that repeat across documents: every run of WINDOW words that also starts in a smaller document.

Documents are taken in chunks of CHUNK bytes of text, which are cut from the input in each step. A chunk's name is a hash of its contents and place, so steps meet only
if they saw the same chunk; an input whose rows or partitions come out differently when they are computed again (by chance, not by a lost executor alone)
is an error in every step, never another result: write such a table first. Nothing here is held whole by the driver or sent to all
tasks: what a chunk has to know comes to it by a shuffle.

1. A count-min sketch. A chunk's windows are hashed to one cell in each of DEPTH rows; per row its distinct cells, and
   whether it met them more than once, go as sorted gaps, compressed, to the shards of the row. A shard merges the partial sketches of all
   chunks; a merged count is never below the count of any window in the cell, so a window that repeats is never missed.
   Back to each chunk goes one bit for each of its cells: met twice or more. Cells are CELLS times the number of windows
   at any size, so a window that doesn't repeat passes all rows with (1 - exp(-1 / CELLS))^DEPTH, 5 %, at most.
2. A chunk and its bits meet; windows all of whose cells were met twice or more are kept, and grouped exactly. Within a
   chunk only a window's smallest document has to be compared with others: the rest are covered already. So a passage that
   a third of all documents share makes one entry a chunk and not one a document. Entries are shuffled by hash, and windows of equal
   96 bits, from two independent hashes of each word, are grouped; all but the smallest document's are covered.
3. A chunk and its covered starts meet, and the covered words are taken out.

Words are runs of other characters than space and 0x09-0x0D, unchanged. Nulls and texts of fewer words have no window.
A document doesn't cover itself, and rows that repeat an id don't cover each other. A null id counts as larger than any
other. Different texts under one id are kept apart. A text longer than CHUNK is a chunk of its own and needs memory in
proportion. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynspark.llm.common import SHORT, mixed, packed, short_keys, table, text_or_empty, unpacked

WINDOW = 13
#: Rows of the sketch; cells in a row for each window at least; windows for each character, about as many as words.
DEPTH, CELLS, PER_CHAR = 2, 4, 1 / 6
#: Bytes of text in a chunk; windows in a shard of the sketch, and in a group of the second pass, on average at most.
CHUNK, SHARD, GROUP = 12 << 20, 1 << 22, 1 << 22
NO_ID = np.iinfo(np.int64).max
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


# --- windows ----------------------------------------------------------------------------------------------------------


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of data, which ends in white space."""
    white = np.r_[True, WHITE[data]]
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word."""
    lengths = ends - starts
    short = lengths <= SHORT
    low, high = short_keys(data, starts[short], lengths[short])
    one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    one[short] = mixed(mixed(low) + high)
    two[short] = mixed(mixed(high ^ np.uint64(ODD[1])) ^ low)
    for i in np.flatnonzero(~short).tolist():
        word = data[starts[i] : ends[i]].tobytes()
        one[i], two[i] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(word, 2)
    return one, two


def rolled(h: np.ndarray, odd: int) -> np.ndarray:
    """A hash of each WINDOW (13 = 8 + 4 + 1) successive numbers."""
    p = lambda k: np.uint64(pow(odd, k, 1 << 64))
    two = h[:-1] + h[1:] * p(1)
    four = two[:-2] + two[2:] * p(2)
    eight = four[:-4] + four[4:] * p(4)
    n = len(h) - WINDOW + 1
    return mixed(eight[:n] + four[8 : 8 + n] * p(8) + h[12 : 12 + n] * p(12))


class Windows:
    """The windows of a chunk: two hashes, number of the document and number of the first word in it."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        """data: texts, each followed by a line feed; sizes: their bytes with it."""
        starts, ends = words_of(data)
        n = len(starts) - WINDOW + 1
        if n <= 0:
            self.h, self.check, self.doc, self.start = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
            return
        one, two = word_hashes(data, starts, ends)
        upto = np.cumsum(sizes)
        doc = np.searchsorted(upto, starts, "right").astype(np.int32)
        first = np.searchsorted(starts, upto - sizes)
        whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        self.h = rolled(one, ODD[0])[whole]
        self.check = (rolled(two, ODD[1])[whole] >> np.uint64(32)).astype(np.uint32)
        self.doc = doc[whole]
        self.start = (whole - first[self.doc]).astype(np.int32)

    def cells(self, row: int, bits: int) -> np.ndarray:
        return (self.h if row == 0 else mixed(self.h + np.uint64(row))) >> np.uint64(64 - bits)


def later(h: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sorted by h, check, ids: which rows have a larger id than the first of their window."""
    if not len(h):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
    return ids != np.repeat(ids[first], np.diff(np.r_[first, len(h)]))


# --- chunks -----------------------------------------------------------------------------------------------------------


def chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """batches: part, id, text of one partition. Name, ids and texts of each chunk, the same whatever the batches are."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = done = part = 0
    for b in batches:
        for p, i, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
            part = p.as_py()
            ids.append(i.as_py())
            texts.append(t.as_py().encode() + b"\n")
            size += len(texts[-1])
            if size >= least:
                yield name_of(part << 32 | done, ids, texts), ids, texts
                ids, texts, size, done = [], [], 0, done + 1
    if ids:
        yield name_of(part << 32 | done, ids, texts), ids, texts


def name_of(place: int, ids: list[int], texts: list[bytes]) -> int:
    """A hash of a chunk's place, ids and texts (each ends in a line feed, and their lengths go with the ids)."""
    digest = xxhash.xxh64(np.array([place, *ids, *map(len, texts)], np.int64).tobytes())
    for t in texts:
        digest.update(t)
    return int(np.uint64(digest.intdigest()).view(np.int64))


def unlike() -> RuntimeError:
    return RuntimeError("a chunk isn't what an earlier step saw: the input changes when it is computed again; write the table first")


def texts_of(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk."""
    for chunk, ids, texts in chunks(batches, least):
        data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        row = (chunk, len(ids), len(data), packed(np.array(ids, np.int64)), packed(sizes), pa.compress(data, codec="zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["chunk", "n", "size", "ids", "sizes", "data"])


TEXTS = "chunk long, n long, size long, ids binary, sizes binary, data binary"


def opened(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes and data of the chunk in a row of texts_of()."""
    r = {c: t.column(c)[0] for c in t.column_names}
    n, size = r["n"].as_py(), r["size"].as_py()
    return unpacked(r["ids"].as_buffer(), np.int64, n), unpacked(r["sizes"].as_buffer(), np.int64, n), unpacked(r["data"].as_buffer(), np.uint8, size)


# --- the sketch -------------------------------------------------------------------------------------------------------


def gaps(values: np.ndarray) -> bytes:
    """Ascending numbers as bytes: the gaps, first the lowest byte of all, then the next, as many as the largest needs."""
    gap = np.diff(values, prepend=values[:1]).astype("<u8")
    wide = max(1, -(-int(gap.max()).bit_length() // 8)) if len(gap) else 1
    planes = gap.view(np.uint8).reshape(-1, 8)[:, :wide].T
    return np.r_[np.frombuffer(np.array(values[:1], "<u8").tobytes(), np.uint8), planes.reshape(-1)].tobytes()


def from_gaps(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    planes = raw[8:].reshape(-1, n)
    gap = np.zeros((n, 8), np.uint8)
    gap[:, : len(planes)] = planes.T
    out = np.cumsum(gap.view("<u8").ravel(), dtype=np.uint64)
    return out + raw[:8].view("<u8")[0]


class Sketch:
    """2^bits cells in each of DEPTH rows, 2^shard_bits shards of a row."""

    def __init__(self, windows: float, parts: int):
        self.bits = min(63, max(16, int(np.ceil(np.log2(max(1.0, windows) * CELLS)))))
        self.shard_bits = min(self.bits, int(np.ceil(np.log2(max(parts, windows / SHARD)))))

    def partial(self, batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
        """batches: part, id, text. Rows shard, chunk, n, size, cells, more: the distinct cells of a chunk, and a bit for each if it was met again."""
        for chunk, _, texts in chunks(batches, least):
            w = Windows(np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts)))
            rows = []
            for row in range(DEPTH):
                met = np.sort(w.cells(row, self.bits))
                first = np.flatnonzero(np.r_[True, met[1:] != met[:-1]]) if len(met) else np.zeros(0, np.int64)
                more = np.diff(np.r_[first, len(met)]) > 1
                met = met[first]
                ends = np.searchsorted(met, np.arange((1 << self.shard_bits) + 1, dtype=np.uint64) << np.uint64(self.bits - self.shard_bits))
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    own, blob = slice(ends[k], ends[k + 1]), gaps(met[ends[k] : ends[k + 1]])
                    rows.append((row << self.shard_bits | k, chunk, int(ends[k + 1] - ends[k]), len(blob), pa.compress(blob, codec="zstd", asbytes=True), np.packbits(more[own]).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["shard", "chunk", "n", "size", "cells", "more"])

    @staticmethod
    def merged(t: pa.Table) -> pa.Table:
        """The rows of one shard. For each: a bit for each of its cells, met twice or more by all chunks together."""
        n = t.column("n").to_numpy()
        cells = [from_gaps(pa.decompress(c.as_buffer(), s, codec="zstd", asbytes=True), k) for c, s, k in zip(t.column("cells"), t.column("size").to_pylist(), n.tolist(), strict=True)]
        more = [np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=k).astype(bool) for m, k in zip(t.column("more"), n.tolist(), strict=True)]
        every, again = np.concatenate(cells), np.concatenate(more)
        order = np.argsort(every)
        at = every[order]
        same = at[1:] == at[:-1]
        often = again.copy()
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        # a cell that one chunk alone met more than once
        bits = [np.packbits(x).tobytes() for x in np.split(often, np.cumsum(n)[:-1])]
        return pa.table({"chunk": t.column("chunk"), "shard": t.column("shard"), "n": t.column("n"), "often": pa.array(bits, pa.binary())})


# --- the second pass --------------------------------------------------------------------------------------------------

ENTRIES = "group long, chunk long, docs long, n long, asked long, " + ", ".join(f"{c} binary" for c in "abcdef")


def entries(t: pa.Table, bits: pa.Table, sketch: Sketch, groups: int) -> pa.Table:
    """A chunk (of texts_of()) and its bits (of merged()). Rows for each group, of the windows that may repeat: a (of docs: ids), c, d (of n windows:
    document in a, start), b (of the documents in a: number in the chunk), e, f (of the last asked windows: hashes); the others are covered already."""
    rows = []
    if bits.num_rows and not t.num_rows:
        raise unlike()
    if t.num_rows:
        ids, sizes, data = opened(t)
        w = Windows(data, sizes)
        if len(w.h) and not bits.num_rows:
            raise unlike()
        take = np.ones(len(w.h), bool)
        bits = bits.sort_by("shard")
        row_of, n = bits.column("shard").to_numpy() >> sketch.shard_bits, bits.column("n").to_numpy()
        for row in range(DEPTH if len(w.h) else 0):
            own = np.flatnonzero(row_of == row).tolist()
            often = np.concatenate([np.unpackbits(np.frombuffer(bits.column("often")[k].as_buffer(), np.uint8), count=int(n[k])) for k in own]).astype(bool)
            cells = w.cells(row, sketch.bits)
            order = np.argsort(cells)
            which = np.cumsum(np.r_[False, cells[order][1:] != cells[order][:-1]])
            if which[-1] + 1 != len(often):
                raise unlike()
            take[order] &= often[which]
        h, check, doc, start = (x[take] for x in (w.h, w.check, w.doc, w.start))
        order = np.lexsort((ids[doc], check, h))
        h, check, doc, start = (x[order] for x in (h, check, doc, start))
        known = later(h, check, ids[doc])
        chunk = t.column("chunk")[0].as_py()
        group = np.where(known, mixed(np.full(1, chunk, np.int64).view(np.uint64)), h) % np.uint64(groups)
        order = np.lexsort((~known, group))
        group, known = group[order], known[order]
        ends = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
        for g in np.flatnonzero(np.diff(ends)).tolist():
            own = order[ends[g] : ends[g + 1]]
            asked = own[int(known[ends[g] : ends[g + 1]].sum()) :]
            docs, of = np.unique(doc[own], return_inverse=True)
            rows.append((g, chunk, len(docs), len(own), len(asked), *map(packed, (ids[docs], docs, of.astype(np.uint32), start[own], h[asked], check[asked]))))
    names = ["group", "chunk", "docs", "n", "asked", *"abcdef"]
    columns = zip(*rows, strict=True) if rows else [()] * 11
    return pa.table({name: pa.array(x, pa.int64() if k < 5 else pa.binary()) for k, (name, x) in enumerate(zip(names, columns, strict=True))})


STARTS = "chunk long, n long, docs binary, starts binary"


def covered(t: pa.Table) -> pa.Table:
    """The rows of one group. For each chunk: document (number in the chunk) and start of each covered window."""
    done, asked = [], []
    for r in t.to_pylist():
        ids, docs = unpacked(r["a"], np.int64, r["docs"]), unpacked(r["b"], np.int32, r["docs"])
        of, start = unpacked(r["c"], np.uint32, r["n"]), unpacked(r["d"], np.int32, r["n"])
        h, check, k = unpacked(r["e"], np.uint64, r["asked"]), unpacked(r["f"], np.uint32, r["asked"]), r["n"] - r["asked"]
        chunk = np.full(r["n"], r["chunk"])
        done.append((chunk[:k], docs[of[:k]], start[:k]))
        asked.append((chunk[k:], docs[of[k:]], start[k:], ids[of[k:]], h, check))
    chunk, doc, start, ids, h, check = (np.concatenate(x) for x in zip(*asked, strict=True))
    order = np.lexsort((ids, check, h))
    hit = order[later(h[order], check[order], ids[order])]
    done.append((chunk[hit], doc[hit], start[hit]))
    chunk, doc, start = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.lexsort((start, doc, chunk))
    chunk, doc, start = chunk[order], doc[order], start[order]
    first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.zeros(0, np.int64)
    rows = [(int(chunk[a]), int(b - a), packed(doc[a:b]), packed(start[a:b])) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(chunk)], strict=False)]
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.table({name: pa.array(x, pa.int64() if k < 2 else pa.binary()) for k, (name, x) in enumerate(zip(("chunk", "n", "docs", "starts"), columns, strict=True))})


CLEANED = "id long, n_words long, n_removed long, kept string"


def cleaned(t: pa.Table, starts: pa.Table) -> pa.Table:
    """A chunk and its covered starts. A row for each of its documents."""
    out = []
    if starts.num_rows and not t.num_rows:
        raise unlike()
    if t.num_rows:
        ids, sizes, data = opened(t)
        n = starts.column("n").to_pylist()
        doc, start = (np.concatenate([np.zeros(0, np.int32), *(unpacked(x.as_buffer(), np.int32, k) for x, k in zip(starts.column(c), n, strict=True))]) for c in ("docs", "starts"))
        order = np.argsort(doc, kind="stable")
        start, of = start[order], np.searchsorted(doc[order], np.arange(len(ids) + 1)).tolist()
        upto, text = np.cumsum(sizes).tolist(), data.tobytes()
        for k, (i, a, b) in enumerate(zip(ids.tolist(), [0, *upto], upto, strict=False)):
            out.append((None if i == NO_ID else i, *without(text[a:b].split(), start[of[k] : of[k + 1]])))
    columns = zip(*out, strict=True) if out else [()] * 4
    return pa.table({name: pa.array(x, pa.int64() if k < 3 else pa.string()) for k, (name, x) in enumerate(zip(("id", "n_words", "n_removed", "kept"), columns, strict=True))})


def without(words: list[bytes], starts: np.ndarray) -> tuple[int, int, str]:
    """Number of words, number of them in windows with these starts, and the others joined."""
    if not len(starts):
        return len(words), 0, b" ".join(words).decode()
    step = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + WINDOW, minlength=len(words) + 1)
    bad = np.cumsum(step[:-1]) > 0
    return len(words), int(bad.sum()), b" ".join([w for w, x in zip(words, bad.tolist(), strict=True) if not x]).decode()


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept (the words that stay, joined by one space)."""
    own = docs.select(F.spark_partition_id().alias("part"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), text_or_empty(text_col).alias("text"))
    windows = (own.agg(F.sum(F.length("text"))).first()[0] or 0) * PER_CHAR
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketch, groups = Sketch(windows, tasks), max(tasks, int(windows / GROUP))
    texts = own.mapInArrow(lambda b: texts_of(b, chunk), TEXTS)
    bits = own.mapInArrow(lambda b: sketch.partial(b, chunk), "shard long, chunk long, n long, size long, cells binary, more binary")
    bits = bits.groupBy("shard").applyInArrow(Sketch.merged, "chunk long, shard long, n long, often binary")
    asked = texts.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(lambda t, b: entries(t, b, sketch, groups), ENTRIES)
    starts = asked.groupBy("group").applyInArrow(covered, STARTS)
    out = texts.groupBy("chunk").cogroup(starts.groupBy("chunk")).applyInArrow(cleaned, CLEANED)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, k, array_to_string(w[k:k + 12], chr(10)) AS passage FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM split WHERE len(w) >= 13)),
firsts AS (SELECT passage, min(doc_id) AS least FROM windows GROUP BY passage),
covered AS (SELECT doc_id, k FROM windows JOIN firsts USING (passage) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM split),
marked AS (
  SELECT doc_id, word, k, max(CASE WHEN c.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN covered c USING (doc_id, k)),
kept AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone = 0), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
