"""Chat formatting: records of several layouts become canonical turns, turns become one text with a loss mask.

A record's layout is told by a schema fingerprint: a hash of its nested field paths, as far as any layout names them. A table
of fingerprints, one for each set of optional fields, selects a declarative mapping to turns (role, text). DataFrames are
fingerprinted by their schema and mapped by column expressions; records in JSON strings are fingerprinted one by one.
A fingerprint that no layout has raises an error for a DataFrame; a JSON record gives no turns and layout null.

The template writes a turn as "### role: text</turn>" and a line feed. Inside roles and texts a backslash, "###" and
"</turn>" are written as \\\\, \\h and \\t (and ":" in a role as \\c), so control strings stand in the output for turns
alone and reading it back gives the very turns. The loss mask is the spans of the assistants' texts.

Turns that come as rows are shuffled by conversation and stream through a task in order of turn, role and text, nulls
first; a task holds one conversation at a time, which its formatted text has to be in any case. Null texts and roles
count as empty. Rows that repeat a turn are turns of their own. A null conversation is a conversation. Empty tables give
empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dynspark.llm.common import table

LOSS_ROLE = "assistant"
#: Names of roles in records of several turns and what they are called in turns; rows of one turn keep theirs.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "prompter": "user"}


class Layout(NamedTuple):
    """A declarative mapping. fields: (role, path, needed) in order of turns. Or items: path of a list, with role and text fields in it."""

    name: str
    fields: tuple[tuple[str, str, bool], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    rows: bool = False  # a record is one turn: role, text, in order of turn

    def variants(self) -> Iterator[frozenset[str]]:
        if self.rows:
            yield frozenset((self.role, self.text, "turn"))
        elif self.items:
            yield frozenset((f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"))
        else:
            needed = [p for _, p, n in self.fields if n]
            free = [p for _, p, n in self.fields if not n]
            for some in chain.from_iterable(combinations(free, k) for k in range(len(free) + 1)):
                yield frozenset((*needed, *some))


LAYOUTS = (
    Layout("turn rows", role="role", text="text", rows=True),
    Layout("messages", items="messages", role="role", text="content"),
    Layout("from and value", items="conversations", role="from", text="value"),
    Layout("turns", items="turns", role="role", text="text"),
    Layout("instruction", (("system", "system", False), ("user", "instruction", True), ("user", "input", False), ("assistant", "output", True))),
    Layout("prompt and completion", (("system", "system", False), ("user", "prompt", True), ("assistant", "completion", True))),
    Layout("prompt and response", (("system", "system", False), ("user", "prompt", True), ("assistant", "response", True))),
    Layout("question and answer", (("system", "system", False), ("user", "question", True), ("user", "context", False), ("assistant", "answer", True))),
    Layout("nested prompt", (("system", "data.system", False), ("user", "data.prompt", True), ("assistant", "data.response", True))),
)


def fingerprint(paths: Iterable[str]) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(v): layout for layout in LAYOUTS for v in layout.variants()}
NAMED = frozenset(p for layout in LAYOUTS for v in layout.variants() for p in v)


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def value_paths(value: object, at: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from value_paths(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        for v in value:
            yield from value_paths(v, f"{at}[]")
    elif value is not None:
        yield at


def layout_of(paths: Iterable[str]) -> Layout | None:
    return MAPPINGS.get(fingerprint(set(paths) & NAMED))


def canonical(df: DataFrame, id_col: str) -> DataFrame:
    """conv, turns (array of role, text) for records of one layout; conv, turn, role, text if a record is one turn."""
    layout = layout_of(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(set(schema_paths(df.schema)) & NAMED)}")
    string = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if layout.rows:
        return df.select(F.col(id_col).alias("conv"), F.col("turn").cast("long").alias("turn"), string(F.col(layout.role)).alias("role"), string(F.col(layout.text)).alias("text"))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    if layout.items:
        turns = F.transform(F.coalesce(F.col(layout.items), F.array()), lambda x: turn(role_of(string(x[layout.role])), string(x[layout.text])))
    else:
        there = set(schema_paths(df.schema))
        given = [F.when(F.col(p).isNotNull() | F.lit(n), turn(F.lit(role), string(F.col(p)))) for role, p, n in layout.fields if p in there]
        turns = F.filter(F.array(*given), lambda x: x.isNotNull())
    return df.select(F.col(id_col).alias("conv"), turns.alias("turns"))


def role_of(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[c], c)


def record_turns(text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout's name and the turns of one JSON record."""
    try:
        record = json.loads(text or "")
    except ValueError:
        return None, []
    layout = layout_of(value_paths(record)) if isinstance(record, dict) else None
    if layout is None or layout.rows:
        return None, []
    string = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x)
    if layout.items:
        found = [(string(x.get(layout.role)), string(x.get(layout.text))) for x in record[layout.items] if isinstance(x, dict)]
        return layout.name, [(ROLES.get(r, r), t) for r, t in found]
    turns = []
    for role, path, _ in layout.fields:
        value: object = record
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is not None:
            turns.append((role, string(value)))
    return layout.name, turns


def canonical_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv, layout, turns for records in JSON strings, each of its own layout."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [record_turns(x) for x in b.column(1).to_pylist()]
            turns = pa.array([[{"role": r, "text": t} for r, t in x] for _, x in found], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.string()), turns], ["conv", "layout", "turns"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("conv"), F.col(json_col).cast("string")).mapInArrow(work, f"conv {kind}, layout string, turns array<struct<role:string,text:string>>")


# --- the template -----------------------------------------------------------------------------------------------------


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\t")


BACK = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":"}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text) if "\\" in text else text


def write(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the loss spans in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = "### " + escape(role).replace(":", "\\c") + ": ", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, "</turn>\n")
        at += len(head) + len(body) + 8
    return "".join(out), spans


def read(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split("</turn>\n")[:-1]:
        head, _, body = part.partition(": ")
        turns.append((unescape(head[4:]), unescape(body)))
    return turns


FORMATTED = "formatted string, loss array<struct<start:long,end:long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rows(convs: list, written: list[tuple[str, list[tuple[int, int]]]], kind: pa.DataType) -> pa.RecordBatch:
    spans = [[{"start": a, "end": b} for a, b in s] for _, s in written]
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array([t for t, _ in written], pa.string()), pa.array(spans, SPANS)], ["conv", "formatted", "loss"])


def formatted(turns: DataFrame) -> DataFrame:
    """conv, formatted, loss (spans in code points) of canonical turns, as lists or as rows."""
    kind = turns.schema["conv"].dataType.simpleString()
    if "turns" in turns.columns:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _rows(b.column(0).to_pylist(), [write((t["role"], t["text"]) for t in x or []) for x in b.column(1).to_pylist()], b.schema.field(0).type)

        return turns.select("conv", "turns").mapInArrow(work, f"conv {kind}, {FORMATTED}")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, convs, done, size, field = None, [], [], [], 0, None
        for b in batches:
            field = b.schema.field(0).type
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if own and conv != at:
                    convs.append(at)
                    done.append(write(own))
                    size += len(done[-1][0])
                    own = []
                    if size > 1 << 22:
                        yield _rows(convs, done, field)
                        convs, done, size = [], [], 0
                at = conv
                own.append((role, text))
        if own:
            yield _rows([*convs, at], [*done, write(own)], field)

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.select("conv", "role", "text").mapInArrow(stream, f"conv {kind}, {FORMATTED}")


def read_back(out: DataFrame) -> DataFrame:
    """What formatted() wrote, read from its text and mask: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = out.schema["conv"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, loss in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                turns = read(text)
                masked = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                every = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), sha256(every.encode()).hexdigest(), len(masked), sha256(masked.encode()).hexdigest(), len(text)))
            if rows:
                kinds = (b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return out.select("conv", "formatted", "loss").mapInArrow(work, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = canonical(rows.unionByName(more), "conv_id")
    return read_back(formatted(turns)).withColumnRenamed("conv", "conv_id")


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS role_out,
         replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS text_out
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(14 + length(role_out) + length(text_out)) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""
