"""Token ids in training order, in binary shards of fixed stride.

Each document's ids and an end token are cut into sequences of SEQUENCE ids, the last one padded. All sequences are
numbered (partition by partition, from the counts of each partition, a number a task), and a keyed Feistel permutation
of the numbers, walked until it lands inside their range, gives each its global slot: a bijection that needs no sort and
no table. Shard k holds the slots from k x SHARD on, and a range of slots is a partition (repartitionById): a group of
neighbouring shards, of which there are more the more shards there are (group()), so that mappers x partitions grows with the square root
of the data. A task sorts its group by shard, fills one shard at a time in place, whatever order its parts come in,
and writes it under another name first, so that a lost or repeated task does no harm. A slot's place in the files is
arithmetic: reading can begin or go on at any slot.

Between the tasks that encode and those that write, sequences for one shard travel together, compressed. The encoded
chunks are persisted between counting and placing, in memory as far as there is, else on disk, and given up when the
shards are written; a lost part is made again from the input.

A null or empty text makes one sequence that is an end token alone. Null ids are kept. Repeated rows are sequences of
their own. An empty table gives no shard and an empty result. Slots follow from how the table is partitioned: runs over the
same files agree. A table that comes out differently when a lost part is computed again (after a shuffle whose order isn't
fixed) is an error if a partition's count changes: write such a table first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, groupby
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynspark.llm.bpe import default_path, slices, vocabulary
from dynspark.llm.common import mixed, shared_dir, table, text_or_empty

#: Ids in a sequence; sequences in a shard (16 MB of 2-byte ids); sequences' bytes that a task gathers before it sends them.
SEQUENCE, SHARD, CHUNK = 512, 1 << 14, 1 << 24
ROUNDS, KEY = 6, 0x5DEECE66D
NO_ID = np.iinfo(np.int64).max
HEAD = np.dtype([("slot", "<i8"), ("id", "<i8"), ("part", "<i4"), ("n", "<i4")])


class Layout(NamedTuple):
    folder: str
    sequences: int
    length: int
    shard: int
    dtype: str

    def file(self, k: int) -> str:
        return f"{self.folder}/shard-{k:08d}.bin"


def permuted(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 .. n - 1: a balanced Feistel network over an even number of bits, applied until the result is below n."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def group(shards: int) -> int:
    """Shards that one task writes: 1 up to 63 shards, 250 (of 16 MB) at a million, which makes 4,000 tasks."""
    return max(1, isqrt(shards // 16))


def packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> bytes:
    return pa.decompress(data, n, codec="zstd", asbytes=True)


def encoded_chunks(docs: DataFrame, path: str, length: int) -> DataFrame:
    """docs: id, text. A row for each chunk of documents: n (documents), sequences, ids, counts (of tokens), tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        wide = bpe.dtype().itemsize
        end = max(bpe.added.values(), default=bpe.size - 1)
        ids: list[int] = []
        counts: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            own, all_tokens = np.concatenate(counts), np.concatenate(tokens)
            row = (len(ids), int((-(-own // length)).sum()), packed(np.array(ids, np.int64).tobytes()), packed(own.tobytes()), all_tokens.nbytes, packed(all_tokens.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["n", "sequences", "ids", "counts", "bytes", "tokens"])

        for b in slices(batches):
            ids += [NO_ID if i is None else i for i in b.column(0).to_pylist()]
            new, n = bpe.encode(b.column(1).to_pylist())
            last = np.cumsum(n + 1) - 1
            out = np.full(len(new) + len(n), end, bpe.dtype)
            own = np.ones(len(out), bool)
            own[last] = False
            out[own] = new
            counts.append(n + 1)
            tokens.append(out)
            size += len(out) * wide
            if size >= CHUNK:
                yield chunk()
                ids, counts, tokens, size = [], [], [], 0
        if ids:
            yield chunk()

    return docs.mapInArrow(work, "n long, sequences long, ids binary, counts binary, bytes long, tokens binary")


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, shard: int = SHARD, key: int = KEY) -> tuple[DataFrame, Layout]:
    """Writes the shards and, beside them, the manifest; returns it and the layout. Manifest: doc_id, part, n_tokens, slot, shard, offset (bytes) of each sequence."""
    path = path or default_path()
    dtype = np.dtype(vocabulary(path).dtype)
    chunks = encoded_chunks(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), path, length)
    chunks = chunks.persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["p"]: r["n"] for r in chunks.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("sequences").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(counts):
        first[p], total = total, total + counts[p]
    layout = Layout(folder, total, length, shard, dtype.str)
    shards = max(1, -(-total // shard))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        at = first.get(partition, 0)
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(unpacked(r["ids"], 8 * r["n"]), np.int64)
                counts_ = np.frombuffer(unpacked(r["counts"], 8 * r["n"]), np.int64)
                tokens = np.frombuffer(unpacked(r["tokens"], r["bytes"]), dtype)
                parts = -(-counts_ // length)
                of = np.repeat(np.arange(len(ids)), parts)
                part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                begin = (np.cumsum(counts_) - counts_)[of] + part * length
                head = np.zeros(len(of), HEAD)
                head["slot"], head["id"], head["part"] = permuted(np.arange(at, at + len(of)), total, key), ids[of], part
                head["n"] = np.minimum(counts_[of] - part * length, length)
                at += len(of)
                order = np.argsort(head["slot"], kind="stable")
                ends = np.searchsorted(head["slot"][order], np.arange(shards + 1) * shard)
                rows = []
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    own = order[ends[k] : ends[k + 1]]
                    h = head[own]
                    places = begin[own][:, None] + np.arange(length)
                    data = tokens[places[np.arange(length) < h["n"][:, None]]]
                    rows.append((k, len(h), packed(h.tobytes()), data.nbytes, packed(data.tobytes())))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "n", "head", "bytes", "tokens"])
        if at - first.get(partition, 0) != counts.get(partition, 0):
            raise RuntimeError("the partition isn't what was counted; persist or write the table first")

    def filled(k: int, parts: Iterator[dict]) -> pa.RecordBatch:
        out, heads = np.zeros((min(shard, total - k * shard), length), dtype), []
        for r in parts:
            h = np.frombuffer(unpacked(r["head"], HEAD.itemsize * r["n"]), HEAD)
            tokens = np.frombuffer(unpacked(r["tokens"], r["bytes"]), dtype)
            rows = np.zeros((len(h), length), dtype)
            rows[np.arange(length) < h["n"][:, None]] = tokens
            out[h["slot"] - k * shard] = rows
            heads.append(h)
        every = np.concatenate(heads)
        if len(every) != len(out):
            raise RuntimeError(f"shard {k} has {len(every)} sequences for {len(out)} slots; persist or write the table first")
        put(layout.file(k), out.tobytes())
        ids = pa.array(every["id"].copy(), pa.int64(), mask=every["id"] == NO_ID)
        columns = [ids, every["part"].copy(), every["n"].copy(), every["slot"].copy(), np.full(len(every), k, np.int32), (every["slot"] - k * shard) * length * dtype.itemsize]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["doc_id", "part", "n_tokens", "slot", "shard", "offset"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by shard
        rows = chain.from_iterable(b.to_pylist() for b in batches)
        for k, parts in groupby(rows, lambda r: r["shard"]):
            yield filled(k, parts)

    dealt = chunks.select("n", "ids", "counts", "bytes", "tokens").mapInArrow(placed, "shard int, n long, head binary, bytes long, tokens binary")
    near = group(shards)
    dealt = dealt.repartitionById(-(-shards // near), F.floor(F.col("shard") / near).cast("int")).sortWithinPartitions("shard")
    try:
        dealt.mapInArrow(written, "doc_id long, part int, n_tokens int, slot long, shard int, offset long").write.parquet(f"{folder}/manifest")
    finally:
        chunks.unpersist()
    return docs.sparkSession.read.parquet(f"{folder}/manifest"), layout


def put(name: str, data: bytes) -> None:
    """Write a file under a name of its own and give it its name when it is whole."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(name) if ":/" in name else (fs.LocalFileSystem(), name)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(data)
    store.move(own, path)


def read(layout: Layout, slot: int, n: int) -> np.ndarray:
    """The sequences of slots slot .. slot + n - 1, in order: seeks to the first and reads on."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(layout.folder) if ":/" in layout.folder else (fs.LocalFileSystem(), "")
    stride, stop, parts = layout.length * np.dtype(layout.dtype).itemsize, min(slot + n, layout.sequences), []
    while slot < stop:
        k, at = divmod(slot, layout.shard)
        take = min(stop - slot, layout.shard - at)
        name = layout.file(k)
        with store.open_input_file(fs.FileSystem.from_uri(name)[1] if ":/" in name else name) as f:
            f.seek(at * stride)
            parts.append(np.frombuffer(f.read(take * stride), layout.dtype).reshape(-1, layout.length))
        slot += take
    return np.concatenate(parts) if parts else np.zeros((0, layout.length), layout.dtype)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")[0]
