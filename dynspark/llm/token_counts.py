"""Numbers of tokens of whole texts under a public tokenizer, without keeping a token.

A SentencePiece .model file counts as that library does, a tokenizers .json file as the other one does, both without tokens
that a text doesn't hold. An Arrow batch of texts is regrouped into calls of about CALL_BYTES bytes each, whatever lengths
its rows have, and only lengths come back. No rows are shuffled.

A text of more than UNIT characters is cut where no token can reach across: between two characters that stand side by side
in no piece of the vocabulary (a byte-pair merge across them would be such a piece; a character without a piece is bytes of
its own). A later part begins with a line feed of our own, which stands beside nothing in any piece, so that the word mark
that the library puts before a text falls on it; both are taken off its count. A text without such a place, a model that changes its
input before encoding it, and the texts of a .json file are encoded whole, with memory in proportion to the text.

A null or empty text has no bytes and no tokens. Repeated rows are counted each; ids are never looked at, so null ids stay. An empty
table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynspark.llm.common import table, text_or_empty

#: Bytes of the texts of one call of the library, about; characters after which a text is cut.
CALL_BYTES, UNIT = 1 << 20, 1 << 16
#: Bytes of a tokenizer's file, which every worker gets, at most.
MOST_FILE = 1 << 26
LIMIT = 4096
#: What SentencePiece writes for a space (fixed value).
MARK = "▁"


class Counter:
    """Counts tokens with a file's library."""

    def __init__(self, kind: str, data: bytes):
        self.cuts, self.lead = False, 0
        if kind == "json":
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(data.decode())
            library.no_padding()
            library.no_truncation()
            self.lengths = lambda texts: [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]
            return
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.lengths = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
        pairs, alone = set(), True
        for k in range(library.get_piece_size()):
            if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k)):
                piece = library.id_to_piece(k)
                alone = alone and "\n" not in piece
                pairs.update(zip(map(ord, piece), map(ord, piece[1:])))
        self.pairs = np.sort(np.array([a << 21 | b for a, b in pairs], np.int64))
        self.lead = self.lengths(["\n"])[0]
        odd = " a  ﬁ Å\tb "  # a ligature, doubled white space: a model that changes its input doesn't give it back
        self.cuts = alone and library.decode(library.encode(odd)) == odd

    def _safe(self, text: str) -> np.ndarray:
        """Where text may be cut: before its k-th character, k from 1."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        codes[codes == 32] = ord(MARK)
        joined = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, joined), len(self.pairs) - 1)
        return np.flatnonzero(self.pairs[at] != joined) + 1

    def _place(self, text: str, begin: int, unit: int) -> int | None:
        """The last place to cut at within unit characters from begin on, else the first one after them."""
        own = self._safe(text[begin : begin + unit])
        if len(own):
            return begin + int(own[-1])
        for at in range(begin + unit - 1, len(text) - 1, unit):
            own = self._safe(text[at : at + unit + 1])
            if len(own):
                return at + int(own[0])
        return None

    def parts(self, text: str, unit: int) -> Iterator[str]:
        """text in parts of about unit characters whose numbers of tokens add up; all but the first begin with a line feed more."""
        begin, lead = 0, ""
        while self.cuts and len(text) - begin > unit and (end := self._place(text, begin, unit)) is not None:
            yield lead + text[begin:end]
            begin, lead = end, "\n"
        yield lead + text[begin:]

    def counts(self, texts: pa.Array, unit: int = UNIT) -> np.ndarray:
        """The number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        held: list[tuple[int, int, str]] = []  # row, tokens that aren't the text's, part
        size = 0

        def settle() -> None:
            np.add.at(total, [row for row, _, _ in held], np.array(self.lengths([part for _, _, part in held])) - [more for _, more, _ in held])
            held.clear()

        for row, text in enumerate(texts):
            for k, part in enumerate(self.parts(text.as_py(), unit)):
                held.append((row, self.lead if k else 0, part))
                size += len(part.encode())
                if size >= CALL_BYTES:
                    settle()
                    size = 0
        if held:
            settle()
        return total


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens, over_limit (more than limit tokens)."""
    path = path or default_path()
    with open(path, "rb") as f:
        data = f.read(MOST_FILE + 1)
    if len(data) > MOST_FILE:
        raise ValueError(f"a tokenizer of more than {MOST_FILE} bytes isn't sent to workers")
    shared = docs.sparkSession.sparkContext.broadcast(("json" if path.endswith(".json") else "model", data))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for b in batches:
            size = pc.cast(pc.binary_length(b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(counter.counts(b.column(1)))], ["id", "n_bytes", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)).mapInArrow(work, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
