"""Byte-pair encoding and decoding of whole texts with a given public vocabulary.

The vocabulary is a tokenizers JSON file of the kind: words end in a suffix, NFC, white space to one space, lower case,
a split into contractions, runs of letters, single digits and runs of other signs. Encoding gives what that library gives
without special tokens added; strings of added tokens inside a text are those tokens.

Texts are taken in blocks of about BLOCK_CHARS characters. In a block, characters are classed and cut into pieces in
numpy, and pieces of up to SHORT bytes are looked up, all at once, in a table of fixed size that the worker keeps: two
slots for a piece, older ones stay in the first. A worker's memory is thus bounded in bytes, whatever words there are.
Pieces that aren't in the table are merged together: each has a segment tree over the ranks of its adjacent pairs; the
root is the leftmost pair of lowest rank; merging it changes three leaves and their paths to the root, and a piece is
done when its root is infinite. Long pieces that few others keep company have a tree of their own in plain lists: n log n steps.

Nulls and texts without words have no tokens. A very long text is cut at white space, which no piece crosses; one without
any needs memory in proportion. Repeated rows are encoded each. An empty table gives an empty result. Other columns are passed through by encode() and decode().
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dynspark.llm.common import SHORT, short_keys, spans, table, text_or_empty

#: Kinds of characters.
OTHER, LETTER, DIGIT, SPACE, CAPITAL = range(5)
#: White space of the vocabulary's pattern (fixed value).
WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Letters and digits of Unicode 16, which the pattern knows and Python's tables (15.1) don't (fixed values).
LETTERS_16 = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
DIGITS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Capitals of Unicode 16 and 17 and their lower case (fixed values): first, last, first in lower case.
CAPITALS_17 = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
LOWER_17 = {a + k: low + k for a, b, low in CAPITALS_17 for k in range(b - a + 1)}
#: Letters after an apostrophe that belong to it (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters of a block, bytes of a slice: of a worker's arrays for them some are 8 times as long or more; bits of the number of slots in each half of the table.
BLOCK_CHARS, SLICE_BYTES, SLOT_BITS = 1 << 18, 1 << 18, 18
#: Cells of the segment trees that are merged at once; pieces of a width that are merged together at least.
CELLS, COMPANY = 1 << 18, 16
#: Tokens that are spelled at once.
STEP = 1 << 15
INFINITE = np.int64(1) << 62


def byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level vocabularies: itself if printable, else the next letter from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, after = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], after = chr(after), after + 1
    return [letters[b] for b in range(256)]


def kinds_of_characters() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    kinds[:0x40000] = [LETTER if c[0] == "L" else DIGIT if c[0] == "N" else OTHER for c in map(unicodedata.category, map(chr, range(0x40000)))]  # none beyond
    for ranges, kind in ((LETTERS_16, LETTER), (DIGITS_16, DIGIT)):
        for r in ranges.split():
            a, b = (int(x, 16) for x in r.split("-"))
            kinds[a : b + 1] = kind
    kinds[[k for k in range(0x3001) if WHITE.match(chr(k))]] = SPACE
    kinds[list(LOWER_17)] = CAPITAL
    return kinds


class Pieces:
    """Ids of pieces of at most SHORT bytes, in two tables of 2^bits slots."""

    def __init__(self, dtype: type, bits: int = SLOT_BITS):
        self.bits = bits
        self.low, self.high = np.zeros(2 << bits, np.uint64), np.zeros(2 << bits, np.uint64)
        self.counts = np.zeros(2 << bits, np.uint8)
        self.ids = np.zeros((2 << bits, SHORT), dtype)

    def slots(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        shift = np.uint64(64 - self.bits)
        first = ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        second = ((h * np.uint64(0x165667B19E3779F9)) >> shift).astype(np.int64) + (1 << self.bits)
        return first, second

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where there is none."""
        first, second = self.slots(low, high)
        at = np.where((self.low[first] == low) & (self.high[first] == high), first, -1)
        lost = np.flatnonzero(at < 0)
        other = second[lost]
        at[lost] = np.where((self.low[other] == low[lost]) & (self.high[other] == high[lost]), other, -1)
        return at

    def put(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Keys must be distinct."""
        first, second = self.slots(low, high)
        at, own = np.unique(np.where(self.counts[first] == 0, first, second), return_index=True)
        self.low[at], self.high[at], self.ids[at], self.counts[at] = low[own], high[own], ids[own], counts[own]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.final = np.array([ids[x + end] for x in letters], np.int64)
        self.size = max([*ids.values(), *added.values()]) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        tokens = [b""] * self.size
        for t, i in (ids | added).items():
            tokens[i] = t.encode() + b" "
        self.spelled = np.frombuffer(b"".join(tokens), np.uint8)
        self.spelled_lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.spelled_starts = np.cumsum(self.spelled_lengths) - self.spelled_lengths
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]
        keys = np.array([a * self.size + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([c for *_, c in pairs], np.int64)
        # where a pair's key hashes to, in two tables; what meets in the first is looked up in the second
        self.bits = 64 - max(16, (64 * len(pairs)).bit_length())
        self.places = []
        left = np.arange(len(pairs), dtype=np.int32)
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            table = np.zeros(1 << (64 - self.bits), np.int32)
            at = self.place(self.keys[left], odd)
            table[at] = left
            left = left[table[at] != left]
            self.places.append((np.uint64(odd), table))
        self.rest = left  # as good as always none
        self.kinds = kinds_of_characters()
        self.known = Pieces(self.dtype)

    def place(self, keys: np.ndarray, odd: int | np.uint64) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(odd)) >> np.uint64(self.bits)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        key = left * self.size + right
        (odd, table), (other, more) = self.places
        at = table[self.place(key, odd)]
        found = self.keys[at] == key
        lost = np.nonzero(~found)
        second = more[self.place(key[lost], other)]
        again = self.keys[second] == key[lost]
        at[lost] = second
        found[lost] = again
        for i in self.rest.tolist():
            hit = key == self.keys[i]
            at[hit], found[hit] = i, True
        return np.where(found & (left >= 0) & (right >= 0), self.ranks[at], -1)

    # --- merging ------------------------------------------------------------------------------------------------------

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of data, one after another, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # pieces, their ids
        widths = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 2)))).astype(np.int64)
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                if width > 16 and len(part) < COMPANY:
                    for i in part.tolist():
                        ids = self.merge_one(data[starts[i] : starts[i] + lengths[i]])
                        counts[i] = len(ids)
                        parts.append((np.array([i]), ids))
                else:
                    ids, alive = self.merge_rows(data, starts[part], lengths[part], width)
                    counts[part] = alive.sum(1)
                    parts.append((part, ids[alive]))
        out = np.zeros(int(counts.sum()), self.dtype)
        ends = np.cumsum(counts)
        for part, ids in parts:
            out[spans(ends[part] - counts[part], counts[part])] = ids
        return out, counts

    def merge_rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids in rows of width, and which of them are left."""
        n, column = len(starts), np.arange(width)
        inside = column < lengths[:, None]
        raw = data[np.minimum(starts[:, None] + column, len(data) - 1)]
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for no symbol
        ids[:, :width] = np.where(inside, self.inner[raw], -1)
        row = np.arange(n)
        ids[row, lengths - 1] = self.final[raw[row, lengths - 1]]
        after = np.broadcast_to(np.minimum(column + 1, width), (n, width)).copy()
        after[row, lengths - 1] = width
        before = np.full((n, width + 1), width, np.int64)
        before[:, 1:width] = column[:-1]
        tree = np.full((n, 2 * width), INFINITE, np.int64)
        rank = np.full((n, width), -1, np.int64)
        pair = column < lengths[:, None] - 1
        rank[pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
        tree[:, width:] = np.where(rank >= 0, rank * width + column, INFINITE)
        level = width // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        alive = inside
        flat_ids, flat_after, flat_before, flat_alive, flat_tree = (x.reshape(-1) for x in (ids, after, before, alive, tree))
        live = row[tree[:, 1] < INFINITE]
        while live.size:
            symbols, leaves, root = live * (width + 1), live * width, live * (2 * width)
            rule, i = np.divmod(flat_tree[root + 1], width)
            j = flat_after[leaves + i]
            k, h = flat_after[leaves + j], flat_before[symbols + i]
            merged = self.merged[rule]
            flat_ids[symbols + i] = merged
            flat_alive[leaves + j] = False
            flat_after[leaves + i] = k
            flat_before[symbols + k] = i
            both = self.rank(np.concatenate([merged, flat_ids[symbols + h]]), np.concatenate([flat_ids[symbols + k], merged]))
            right, left = both[: len(live)], both[len(live) :]
            flat_tree[root + width + j] = INFINITE
            flat_tree[root + width + i] = np.where(right >= 0, right * width + i, INFINITE)
            has = np.flatnonzero(h < width)
            flat_tree[(root + width + h)[has]] = np.where(left >= 0, left * width + h, INFINITE)[has]
            nodes = np.stack([width + i, width + j, np.where(h < width, width + h, width + i)])
            while nodes[0, 0] > 1:
                nodes >>= 1
                below = root + 2 * nodes
                flat_tree[root + nodes] = np.minimum(flat_tree[below], flat_tree[below + 1])
            live = live[flat_tree[root + 1] < INFINITE]
        return ids[:, :width], alive

    def merge_one(self, piece: np.ndarray) -> np.ndarray:
        """The ids of one piece; its tree is a list."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids = [*self.inner[piece[:-1]].tolist(), int(self.final[piece[-1]])]
        first = np.array(ids, np.int64)
        leaves = self.rank(first[:-1], first[1:])
        none = int(INFINITE)
        tree = [none] * (2 * width)
        tree[width : width + n - 1] = np.where(leaves >= 0, leaves * width + np.arange(n - 1), INFINITE).tolist()
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))
        ranks, size = self.by_pair(), self.size

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            while at > 1:
                at >>= 1
                now = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == now:
                    break
                tree[at] = now

        def pair(at: int) -> int:
            r = ranks.get(ids[at] * size + ids[after[at]], -1) if after[at] < n else -1
            return none if r < 0 else r * width + at

        while tree[1] < none:
            rule, i = divmod(tree[1], width)
            j = after[i]
            ids[i] = int(self.merged[rule])
            ids[j] = -1
            after[i] = after[j]
            before[after[j]] = i
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return np.array([x for x in ids if x >= 0], self.dtype)

    def by_pair(self) -> dict[int, int]:
        if not hasattr(self, "_by_pair"):
            self._by_pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._by_pair

    # --- texts --------------------------------------------------------------------------------------------------------

    def parts(self, text: str) -> Iterator[str | int]:
        """The ids of added tokens in a text and what lies between, that cut at white space into at most about BLOCK_CHARS."""
        for run in self.split_added.split(text) if self.split_added and "<" in text else (text,):
            if run in self.added:
                yield self.added[run]
                continue
            at = 0
            while len(run) - at > BLOCK_CHARS and (m := WHITE.search(run, at + BLOCK_CHARS // 2)):
                yield run[at : m.start()]
                at = m.start()
            if at < len(run):
                yield run[at:] if at else run

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        counts = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        block: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            if block:
                ids, own = self.encode_block(block)
                out.append(ids)
                np.add.at(counts, owners, own)
                block.clear()
                owners.clear()

        for k, text in enumerate(texts):
            for part in self.parts(text):
                if isinstance(part, int):
                    flush()
                    size = 0
                    out.append(np.array([part], self.dtype))
                    counts[k] += 1
                    continue
                block.append(part)
                owners.append(k)
                size += len(part)
                if size >= BLOCK_CHARS:
                    flush()
                    size = 0
        flush()
        return np.concatenate(out) if out else np.zeros(0, self.dtype), counts

    def encode_block(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [p.lower() if p.isascii() else unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p in parts]
        joined = "\n".join(plain) + "\n"
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(data) == len(joined):
            points, kinds, offsets = data, self.kinds[data], None
        else:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            kinds = self.kinds[points]
            if (kinds == CAPITAL).any():  # letters too new for str.lower()
                joined = joined.translate(LOWER_17)
                data, points = np.frombuffer(joined.encode(), np.uint8), np.frombuffer(joined.encode("utf-32-le"), np.uint32)
                kinds = self.kinds[points]
            wide = (points > 0x7F).astype(np.uint8)
            wide += points > 0x7FF
            wide += points > 0xFFFF
            offsets = np.arange(len(points) + 1)
            offsets[1:] += np.cumsum(wide, dtype=np.int64)
        bounds = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)])
        kind = kinds[bounds]
        start, end = bounds, np.r_[bounds[1:], len(points)]
        hits = np.flatnonzero((kind[:-1] == OTHER) & (kind[1:] == LETTER) & (end[:-1] - start[:-1] == 1) & (points[start[:-1]] == ord("'")))
        if len(hits):
            one, two = points[end[hits]], points[np.minimum(end[hits] + 1, len(points) - 1)]
            take = np.zeros(len(hits), np.int64)
            for c in CONTRACTIONS:
                same = one == ord(c[0])
                take[same & (two == ord(c[1])) if len(c) > 1 else same] = len(c)
            end, start = end.copy(), start.copy()
            end[hits] += take
            start[hits + 1] += take
        keep = (kind != SPACE) & (start < end)
        start, end = start[keep], end[keep]
        first = np.cumsum([0, *map(len, plain[:-1])]) + np.arange(len(plain))  # of each part
        of = np.searchsorted(start, np.r_[first, len(points)])
        if offsets is not None:
            start, end = offsets[start], offsets[end]
        ids, counts = self.ids_of(data, start, end - start)
        ends = np.r_[0, np.cumsum(counts)]
        return ids, np.diff(ends[of])

    def ids_of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of data, one after another, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(lengths <= SHORT)
        column = np.arange(SHORT)
        size = lengths[short]
        low, high = short_keys(data, starts[short], size)
        at = self.known.find(low, high)
        ids = self.known.ids[at]
        counts[short] = self.known.counts[at]
        if len(new := np.flatnonzero(at < 0)):
            order = new[np.lexsort((low[new], high[new]))]
            other = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            own = order[np.r_[True, other]]
            merged, n = self.merge(data, starts[short[own]], size[own])
            table = np.zeros((len(own), SHORT), self.dtype)
            table[column < n[:, None]] = merged
            self.known.put(low[own], high[own], table, n)
            which = np.r_[0, np.cumsum(other)]
            ids[order], counts[short[order]] = table[which], n[which]
        flat = ids[column < counts[short][:, None]]
        if len(short) == len(starts):
            return flat, counts
        long = np.flatnonzero(lengths > SHORT)
        pieces: dict[bytes, int] = {}
        which = np.array([pieces.setdefault(data[a : a + n].tobytes(), len(pieces)) for a, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)])
        own = np.unique(which, return_index=True)[1]
        merged, n = self.merge(data, starts[long[own]], lengths[long[own]])
        counts[long] = n[which]
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), self.dtype)
        out[spans((ends - counts)[short], counts[short])] = flat
        out[spans((ends - counts)[long], counts[long])] = merged[spans((np.cumsum(n) - n)[which], n[which])]
        return out, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens of all texts, joined by one space in each; where each text begins and the last ends."""
        sizes = self.spelled_lengths[ids]
        text = np.concatenate([np.zeros(0, np.uint8), *(self.spelled[spans(self.spelled_starts[ids[k : k + STEP]], sizes[k : k + STEP])] for k in range(0, len(ids), STEP))])
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]
        last = np.ones(len(text), bool)
        last[ends[counts > 0] - 1] = False
        return text[last], np.r_[0, ends - np.cumsum(counts > 0)]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows and, but for single rows, of few bytes in the last column, which is text."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False))
        k = 0
        while k < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right"))
            n = min(max(1, upto - k), rows)
            yield batch.slice(k, n)
            k += n


def encoded(batches: Iterator[pa.RecordBatch], path: str, ids_col: str = "ids") -> Iterator[pa.RecordBatch]:
    """Batches with ids_col, lists of ids, in place of the last column, the text."""
    bpe = vocabulary(path)
    for b in slices(batches, size=SLICE_BYTES):
        ids, counts = bpe.encode([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], ids_col])


def decoded(batches: Iterator[pa.RecordBatch], path: str, text_col: str = "decoded") -> Iterator[pa.RecordBatch]:
    """Batches with text_col added: the tokens of the last column, added tokens too, joined by one space."""
    bpe = vocabulary(path)
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            b = batch.slice(k, 1000)
            lists = b.column(b.num_columns - 1)
            counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            text, ends = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            texts = pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, text_col])


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col, array<int>, in place of its text column."""
    path = path or default_path()
    others = [c for c in docs.columns if c not in (text_col, ids_col)]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    return docs.select(*[F.col(f"`{c}`") for c in others], text_or_empty(text_col)).mapInArrow(lambda b: encoded(b, path, ids_col), schema)


def decode(coded: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """coded with text_col added, as a vocabulary without a decoder of its own has it."""
    path = path or default_path()
    others = [c for c in coded.columns if c not in (ids_col, text_col)]
    schema = T.StructType([*(coded.schema[c] for c in others), coded.schema[ids_col], T.StructField(text_col, T.StringType())])
    return coded.select(*[F.col(f"`{c}`") for c in others], ids_col).mapInArrow(lambda b: decoded(b, path, text_col), schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs (doc_id, text); both ways in one Python worker."""
    path = path or default_path()
    both = docs.select("doc_id", text_or_empty("text")).mapInArrow(lambda b: decoded(encoded(b, path), path), "doc_id long, ids array<int>, decoded string")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
